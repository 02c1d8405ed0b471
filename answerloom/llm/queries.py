"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from answerloom.llm import chat_format, decontaminate, exact_dedup, html_extract, language_id, lm_score, near_dedup, packing, periodic_runs, prefix_trie, substring_dedup, toxicity, url_filter
from answerloom.llm.common import remainder, stored, table
from answerloom.llm.registry import query

OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
lens AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|<ROLE=|</ROLE>>)', '\1\\\2\3', 'g'))
            + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 18 + length(url_encode(role)) END AS size
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM lens GROUP BY conv_id
"""


@query("op1_chat_format", OP1_SQL)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    sample = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", sample), (-1, 1, "assistant", sample)], given.schema)
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    events = (
        given.unionByName(own)
        .withColumn("seq", F.row_number().over(order).cast("long"))
        .select("conv_id", "seq", F.col("seq").alias("turn"), F.lit("message").alias("kind"), "role", "text")
    )
    done = chat_format.format_conversations(events)
    turns = chat_format.read_back(F.col("formatted"))
    learnt = chat_format.loss_text(F.col("pieces"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", "formatted", turns.alias("turns"), learnt.alias("learnt")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op2_html_extract")
def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def _number(engine: str, part: int) -> str:
    """SQL for the number in a part of the md5 text ``h``."""
    return f"CAST(conv(substr(h, {part}, 4), 16, 10) AS INT)" if engine == "spark" else f"CAST(concat('0x', substr(h, {part}, 4)) AS INTEGER)"


def op3_entries(engine: str, pages: str = "pages") -> str:
    """Dated list entries derived from the hosts of all pages (SQL of either engine)."""
    name = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)"
    slash = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1)"
    parent = "regexp_replace(host, '^[^.]*[.]', '')"
    day = lambda e: f"CAST(date_add(DATE '2024-01-01', CAST({e} AS INT)) AS DATE)" if engine == "spark" else f"CAST(DATE '2024-01-01' + CAST({e} AS INTEGER) AS DATE)"
    return f"""
      WITH hosts AS (SELECT DISTINCT lower({name}) AS host FROM {pages} WHERE url IS NOT NULL),
      paths AS (SELECT DISTINCT concat(lower({name}), '/', {slash}) AS path FROM {pages} WHERE url IS NOT NULL AND {slash} <> ''),
      named AS (SELECT host AS key, md5(host) AS h, 'host' AS kind FROM hosts WHERE host <> ''
        UNION ALL SELECT DISTINCT {parent}, md5({parent}), 'parent' FROM hosts WHERE host LIKE '%.%.%'
        UNION ALL SELECT path, md5(path), 'path' FROM paths),
      marked AS (SELECT *, {_number(engine, 1)} AS a, {_number(engine, 5)} AS b FROM named)
      SELECT 'spam' AS list_name, 'block' AS verdict, key, 'add' AS action, {day('a % 200')} AS effective, 1 AS seq FROM marked WHERE kind = 'host'
      UNION ALL SELECT 'spam', 'block', key, 'remove', {day('a % 200 + 20 + b % 90')}, 2 FROM marked WHERE kind = 'host' AND b % 4 <> 0
      UNION ALL SELECT 'spam', 'block', key, 'add', {day('a % 200 + 60 + b % 120')}, 3 FROM marked WHERE kind = 'host' AND b % 3 = 0
      UNION ALL SELECT 'bulk', 'block', key, 'add', {day('a % 300')}, 1 FROM marked WHERE kind = 'parent' AND b % 2 = 0
      UNION ALL SELECT 'trusted', 'allow', key, 'add', {day('a % 250')}, 1 FROM marked WHERE kind = 'path' AND b % 3 = 0
      UNION ALL SELECT 'trusted', 'allow', key, 'remove', {day('a % 250 + b % 60')}, 2 FROM marked WHERE kind = 'path' AND b % 9 = 0"""


OP3_SQL = f"""
WITH entries AS ({op3_entries('duckdb')}),
intervals AS (
  SELECT * FROM (SELECT *, lead(effective) OVER (PARTITION BY list_name, verdict, key ORDER BY effective, seq) AS until FROM entries) e
  WHERE action = 'add' AND (until IS NULL OR until > effective)),
captures AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS DATE) AS fetched,
         nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '.'), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS segment FROM pages),
hits AS (
  SELECT c.page_id, i.*, row_number() OVER (PARTITION BY c.page_id ORDER BY contains(i.key, '/') DESC, length(i.key) DESC, i.verdict = 'allow' DESC, i.list_name) AS rank
  FROM captures c JOIN intervals i
    ON (i.key = c.host OR c.host LIKE concat('%.', i.key) OR (c.segment <> '' AND i.key = concat(c.host, '/', c.segment)))
   AND i.effective <= c.fetched AND (i.until IS NULL OR c.fetched < i.until))
SELECT c.page_id, c.host, c.fetched, coalesce(h.verdict, 'none') AS verdict, h.list_name, h.key AS matched_key, h.effective AS valid_from, h.until AS valid_until
FROM captures c LEFT JOIN (SELECT * FROM hits WHERE rank = 1) h ON c.page_id = h.page_id
"""


@query("op3_url_filter", OP3_SQL)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    name = "op3_pages"
    pages.select("url").createOrReplaceTempView(name)
    entries = spark.sql(op3_entries("spark", name))
    captures = pages.select(
        F.col("page_id").alias("id"), "url", F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("page_id") * 37) % 366).cast("int")).alias("fetched")
    )
    done = url_filter.evaluate(captures, entries)
    return done.select(F.col("id").alias("page_id"), url_filter.host(F.col("url")).alias("host"), "fetched", "verdict", "list_name", "matched_key", "valid_from", "valid_until")


@query("op4_lm_score")
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = docs.filter(remainder("doc_id", 7) != 2)
    counts = stored(lm_score.word_counts(training))
    model = lm_score.learn(training, counts)
    return lm_score.score(docs, counts, model).select(
        "doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


@query("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


@query("op6_exact_dedup", OP6_SQL)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 3) != 1)
    done = toxicity.score(docs, toxicity.learn(docs, labels))
    return done.select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), F.col("_toxic_score").alias("score"),
        (F.col("_toxic_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.filter(remainder("doc_id", 5) != 0))
    return language_id.predict(docs, model).withColumn("held_out", remainder("doc_id", 5) == 0).select("doc_id", "held_out", "lang_pred", "score", "n_words")


@query("op9_near_dedup")
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def repeated_words(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents whose crc32 ends in 0 go round in a part of their own words from some word on."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(h / 10)
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h"), g.alias("g")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    )
    n = F.size("words")
    start = (F.col("g") % F.greatest(n, F.lit(1))).cast("int")
    placed = chosen.withColumns({"n": n, "a": start}).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    times = F.ceil(rest / F.col("p")).cast("int")
    around = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), F.lit(1), rest)
    turned = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), around), " ")
    return placed.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), turned).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = periodic_runs.collapse(repeated_words(table(spark, sf_dir, "documents")))
    best = periodic_runs.longest(F.col("runs"))
    return done.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(periodic_runs.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP13_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS size,
         md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
paths AS (SELECT conv_id, list({'digest': digest, 'size': size} ORDER BY turn NULLS FIRST, digest, size) AS path FROM turns GROUP BY conv_id),
hashes AS (
  SELECT conv_id, path, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
         lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384::BIGINT * (c & 1)))), 4294967295::BIGINT) % 9 AS h
  FROM paths),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(list_slice(b.path, 1, o.h), []), list_slice(o.path, o.h + 1, len(o.path))) AS path
  FROM hashes o LEFT JOIN paths b ON b.conv_id = o.conv_id - o.conv_id % 5),
members AS (
  SELECT conv_id, d, list_transform(list_slice(path, 1, d), lambda t: t.digest) AS node, CASE WHEN d > 0 THEN path[d].size ELSE 0 END AS size, d = len(path) AS ends
  FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY node, d),
childs AS (SELECT list_slice(node, 1, d - 1) AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN childs c ON c.node = n.node),
subtrees AS (
  SELECT list_slice(node, 1, up) AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS up FROM counted) GROUP BY 1)
SELECT c.conv_id, CAST(c.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(c.n_convs AS BIGINT) AS n_convs, CAST(c.n_children AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN subtrees s ON s.node = c.node LEFT JOIN nodes p ON c.d > 0 AND p.d = c.d - 1 AND p.node = list_slice(c.node, 1, c.d - 1)
"""


def grafted(paths: DataFrame) -> DataFrame:
    """(conv, path): the first turns of the conversation at the last multiple of five, then the own turns after as many."""
    kept = (F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % 9).cast("int")
    heads = paths.filter("conv % 5 = 0").select(F.col("conv").alias("base"), F.slice("path", 1, 8).alias("head"))
    own = paths.select("conv", "path", (F.col("conv") - F.col("conv") % 5).alias("base"), kept.alias("h"))
    head = F.slice(F.coalesce("head", F.slice("path", 1, 0)), F.lit(1), F.col("h"))
    return own.join(heads, "base", "left").select("conv", F.concat(head, F.slice("path", F.col("h") + 1, F.greatest(F.size("path"), F.lit(1)))).alias("path"))


@query("op13_prefix_trie", OP13_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(grafted(stored(prefix_trie.paths(table(spark, sf_dir, "conversations")))))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, start, array_to_string(list_slice(w, start + 1, start + 20), ' ') AS passage
  FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS start FROM words WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY passage ORDER BY doc_id, start) AS copy FROM windows) WHERE copy > 1),
covered AS (SELECT DISTINCT doc_id, start + unnest(range(20)) AS place FROM later),
placed AS (SELECT doc_id, w, unnest(range(len(w))) AS place FROM words),
kept AS (
  SELECT p.doc_id, string_agg(p.w[p.place + 1], ' ' ORDER BY p.place) AS kept, count(*) AS n
  FROM placed p ANTI JOIN covered c ON p.doc_id = c.doc_id AND p.place = c.place GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""


@query("op12_substring_dedup", OP12_SQL)
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
