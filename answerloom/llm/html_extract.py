"""Main text of web pages by tag-path ratios (operator 2).

A page is cut into blocks of text; each block has the path of block tags from
the root to its leaf.  Per path the page's text length, punctuation, links and
blocks are summed up.  The ratios of text and of punctuation per block are
smoothed over the paths below the same parent, fused, and lowered where the
text is links.  The landmark on the path (article before main before anything
else) weighs as much as the unlinked text below it, so a few words in an article
do not outweigh a body of text beside it.  The weighted ratio is compared with a
threshold that depends on the heaviest landmark, inside a landmark as well.
Blocks of the paths that pass are the main text.  Paths through menus, forms,
adverts, comments and the like never pass.

Null and empty pages give an empty text.  Broken markup is read as browsers do:
unclosed tags end with their parent, an unclosed comment or script runs to the
end.  Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from answerloom.llm.common import text_chunks

# Tags by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption legend summary".split())
NOT_CONTENT = frozenset("nav footer aside form menu dialog button select option datalist label svg math object canvas audio video map head fieldset".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner sidebar sidenav nav navbar navigation menu "
    "breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond widget toolbar pagination pager "
    "skip copyright disclaimer alert toast search outbrain taboola teaser teasers paywall".split()
)
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FRAME = frozenset("article content main body wrap wrapper container layout page post entry story with has no text".split())
ARTICLE_CLASS = frozenset("articlebody article-body article-content post-content post-body entry-content story-body story-content article-text post-text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
_NAMES = re.compile(r"[A-Za-z]+")

#: What a character of text below a landmark counts.
LANDMARK = {"article": 9.0, "main": 3.0, "": 1.0}
#: Least score of a path, by the page's heaviest landmark.
LEAST = {"article": 0.05, "main": 0.1, "": 0.3}


def _role(tag: str, raw: str, inside: str) -> tuple[bool, str]:
    """Whether the element holds no content, and the landmark it opens."""
    noise = tag in NOT_CONTENT or tag == "header" and not inside
    mark = tag if tag in ("article", "main") else ""
    if raw.strip(" /\n\t\r\f"):
        values: dict[str, str] = {}
        for name, *given, bare in _ATTRIBUTE.findall(raw):
            values.setdefault((name or bare).lower(), "".join(given))
        style = values.get("style", "").replace(" ", "").lower()
        noise = noise or "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
        role = values.get("role", "").lower()
        noise = noise or role in NOISE_ROLE
        names = f"{values.get('class', '')} {values.get('id', '')}".lower()
        if names.strip() and tag not in ("html", "body"):
            if ARTICLE_CLASS & set(names.split()):
                mark = "article"
            for name in names.split():
                parts = set(_NAMES.findall(name))
                if parts & NOISE and not parts & FRAME:
                    noise = True
                elif "header" in parts and not inside and not parts & FRAME:
                    noise = True
        if role == "main":
            mark = mark or "main"
        if role == "article" or values.get("itemprop", "").lower() == "articlebody":
            mark = "article"
    return noise, mark


def blocks(page: str) -> Iterator[tuple[str, str, bool, int]]:
    """(path, text, noise, characters inside links) of each block of text, in page order."""
    stack: list[tuple[str, str, bool, str, int]] = [("", "", False, "", 0)]  # tag, path, noise, landmark, inside a link
    parts: list[str] = []
    linked = at = 0

    def block() -> tuple[str, str, bool, int] | None:
        text = " ".join(references.unescape("".join(parts)).split())
        return (owner[1] + "|" + owner[3], text, owner[2], min(linked, len(text))) if text else None

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            if stack[-1][4]:
                linked += len(raw.strip())

    owner = stack[0]
    position, size = 0, len(page)
    while position < size:
        found = _TOKEN.search(page, position)
        if not found:
            add(page[position:])
            break
        add(page[position : found.start()])
        position = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        closing, raw = found[1] or found[4], (found[3] if found[2] else found[6]) or ""
        if closing:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == tag), 0)
            if not depth or tag in ("body", "html"):
                continue
            if tag not in BLOCK and any(stack[d][0] in BLOCK for d in range(depth + 1, len(stack))):
                continue
            changes = any(e[0] in BLOCK or e[2] != stack[depth - 1][2] for e in stack[depth:])
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, position)
            position = end.end()
            continue
        elif tag in ("br", "wbr") or tag in VOID and tag != "hr":
            if tag == "br":
                parts.append(" ")
            continue
        else:
            depth = len(stack)
            if tag in CLOSES_P:
                depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == "p"), depth)
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                stop = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}[tag]
                same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                for d in range(len(stack) - 1, 0, -1):
                    if stack[d][0] in stop:
                        break
                    if stack[d][0] in same:
                        depth = d
                        break
            changes = True
        if closing:
            upper = stack[depth - 1]
            new = None
        else:
            upper = stack[depth - 1]
            noise, mark = _role(tag, raw, upper[3])
            landmark = "article" if "article" in (mark, upper[3]) else mark or upper[3]
            inline = tag not in BLOCK
            new = (tag, upper[1] if inline and not noise else f"{upper[1]}/{tag}", upper[2] or noise, landmark, upper[4] or tag == "a")
            changes = not inline or noise != False and not upper[2] or depth < len(stack)  # noqa: E712
        if changes:
            done = block()
            if done:
                yield done
            parts.clear()
            linked = 0
        del stack[depth:]
        if new and tag != "hr":
            stack.append(new)
        if changes:
            owner = stack[-1]
    done = block()
    if done:
        yield done


def path_scores(rows: list[tuple[str, str, bool, int]]) -> tuple[dict[str, float], str]:
    """Fused, smoothed and weighted score of each path that may hold content, and the heaviest landmark."""
    paths = list(dict.fromkeys(r[0] for r in rows if not r[2]))
    if not paths:
        return {}, ""
    place = {p: k for k, p in enumerate(paths)}
    count, chars, marks, links = np.zeros((4, len(paths)))
    for path, text, noise, linked in rows:
        if not noise:
            k = place[path]
            count[k] += 1
            chars[k] += len(text)
            marks[k] += len(_PUNCTUATION.findall(text))
            links[k] += linked
    free = 1 - links / chars
    parents = [p.split("|")[0].rpartition("/")[0] for p in paths]
    text_ratio, mark_ratio = _smooth(np.log1p(chars / count), parents), _smooth(np.log1p(marks / count), parents)
    fused = text_ratio * (1 + mark_ratio) * free
    fused = fused / max(fused.max(), 1e-9)
    landmarks = [p.rsplit("|", 1)[1] for p in paths]
    mass = dict.fromkeys(landmarks, 0.0)
    for landmark, size in zip(landmarks, (chars * free).tolist()):
        mass[landmark] += size * LANDMARK[landmark]
    heaviest = max(mass, key=lambda m: (mass[m], LANDMARK[m]))
    weight = np.array([mass[m] for m in landmarks]) / max(mass[heaviest], 1e-9)
    return dict(zip(paths, (weight * fused).tolist())), heaviest


def _smooth(values: np.ndarray, parents: list[str]) -> np.ndarray:
    """Mean of each path's value and the mean of all paths below the same parent."""
    place = {p: k for k, p in enumerate(dict.fromkeys(parents))}
    group = np.array([place[p] for p in parents])
    return (values + (np.bincount(group, values) / np.bincount(group))[group]) / 2


def main_text(page: str) -> str:
    """Main text of one page, blocks joined by line ends."""
    rows = list(blocks(page))
    scores, heaviest = path_scores(rows)
    return "\n".join(text for path, text, noise, _ in rows if not noise and scores[path] >= LEAST[heaviest])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without other columns than page_id and url, with the text and its length."""
    schema = T.StructType([*(pages.schema[c] for c in ("page_id", "url")), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sources in text_chunks(batches, "html"):
            texts = [main_text(s) for s in sources]
            columns = [rows.column("page_id").combine_chunks(), rows.column("url").combine_chunks(), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pages.select("page_id", "url", F.col(html).alias("html")).mapInArrow(read, schema)
