"""One query for each operator, with production parameters, over its whole table; the digests asked of it come last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..streaming.storage import fresh_path
from . import centroids, decontaminate, divergence, near_dedup, pieces, pii, quality, sharding, substring_dedup, token_records, token_rollup, toxicity, url_lists

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def piece_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


@query
def op1_weak_supervision_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "pii.*")
    counts = [F.size(pii.only(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, digest(pii.listed(F.col("base"))).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query
def op3_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dedup.classes(table(spark, folder, "documents"))
    return found.select(F.col("key").alias("doc_id"), near_dedup.hex_digits(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query
def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    h = F.col("hits")
    named = F.array_join(F.sort_array(h["items"].cast("array<string>")), ",")
    return found.select("doc_id", h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"),
                        digest(named).alias("items_sha256"), (h["n_hit"] > 0).alias("contaminated"))


@query
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.assess(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))
    q = F.col("quality")
    return judged.select("doc_id", *[q[c].alias(c) for c in (*quality.COUNTS, "base_failed", "kept", "distance")])


@query
def op6_token_records(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    place = fresh_path(spark, "records")
    written = token_records.write(table(spark, folder, "documents"), place, spec)
    back = token_records.read(written, place, raw=True)
    return back.select(F.col("key").alias("doc_id"), "start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))


@query
def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    found = pieces.pieces(table(spark, folder, "documents").select("doc_id", "text"), piece_model())
    p = F.col("pieces")
    return found.select("doc_id", F.size(p["ids"]).cast("long").alias("n_tokens"),
                        digest(F.array_join(p["ids"].cast("array<string>"), ",")).alias("ids_sha256"),
                        digest(p["decoded"]).alias("decoded_sha256"))


@query
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents")).withColumnRenamed("key", "doc_id")


SHARD_BYTES = 1 << 20


@query
def op2_extendible_sharding(spark: SparkSession, folder: str) -> DataFrame:
    dealt = sharding.assign(table(spark, folder, "documents").select("doc_id", "text"), SHARD_BYTES)
    return dealt.select("doc_id", F.col("shard.name").alias("shard"), F.col("shard.rows").alias("shard_rows"), F.col("shard.bytes").alias("shard_bytes"))


SQL["op2_extendible_sharding"] = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0) AS n FROM documents
), walk AS (
    SELECT doc_id, h, n, 0 AS depth, sum(n) OVER () AS bytes, count(*) OVER () AS num FROM d
    UNION ALL
    SELECT doc_id, h, n, depth + 1, sum(n) OVER (PARTITION BY h >> (59 - depth)), count(*) OVER (PARTITION BY h >> (59 - depth))
    FROM walk WHERE bytes > {SHARD_BYTES} AND num > 1 AND depth < 60
), leaf AS (SELECT * FROM walk WHERE bytes <= {SHARD_BYTES} OR num = 1)
SELECT doc_id, CASE WHEN depth = 0 THEN '*' ELSE lpad(bin(h >> (60 - depth)), depth, '0') END AS shard,
    CAST(num AS BIGINT) AS shard_rows, CAST(bytes AS BIGINT) AS shard_bytes
FROM leaf"""

#: The tables hold no fetch times and no lists. Both follow from ``pages``: a page is fetched on a day of 2024 that its id fixes, and
#: two lists add and remove hosts, and the sites above them, on days that the host's name fixes.
DAYS = 365


def day_of(value: Column, salt: str) -> Column:
    n = F.conv(F.substring(F.md5(F.concat(F.lit(salt), value.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % DAYS
    return F.timestamp_seconds(F.lit(1704067200) + n * 86400)


@query
def op5_temporal_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", day_of(F.col("page_id"), "fetch:"))
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    sites = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("host")).filter("host != ''").distinct()
    entries = None
    for name, of in (("hosts", hosts), ("sites", sites)):
        for salt, added in (("add:", True), ("remove:", False), ("again:", True)):
            part = of.select(F.lit(name).alias("list"), "host", day_of(F.col("host"), salt + name).alias("at"), F.lit(added).alias("added"))
            entries = part if entries is None else entries.unionByName(part)
    v = F.col("verdict")
    return url_lists.evaluate(captures, entries).select(
        "page_id", v["blocked"].alias("blocked"), v["entries"].alias("n_entries"), v["lists"].alias("lists"), v["host"].alias("listed_host"))


def _day(value: str, salt: str) -> str:
    return f"(('0x' || substr(md5('{salt}' || CAST({value} AS VARCHAR)), 1, 8))::BIGINT % {DAYS})"


_HOST = r"nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1), '\.$', ''), '')"
SQL["op5_temporal_url_lists"] = f"""
WITH p AS (SELECT page_id, {_HOST} AS host, {_day('page_id', 'fetch:')} AS d FROM pages),
s AS (SELECT 'hosts' AS list, host FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL) UNION ALL
      SELECT 'sites', site FROM (SELECT DISTINCT regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS site FROM p) WHERE site <> ''),
e AS (SELECT list, host, {_day('host', "add:' || list || '")} AS a, {_day('host', "remove:' || list || '")} AS r, {_day('host', "again:' || list || '")} AS g FROM s),
hit AS (
    SELECT p.page_id, e.list, e.host FROM p JOIN e ON p.host = e.host OR ends_with(p.host, '.' || e.host)
    WHERE (a <> r AND a <= d AND NOT (a < r AND r <= d) OR g <> r AND g <= d AND NOT (g < r AND r <= d)))
SELECT p.page_id, count(hit.host) > 0 AS blocked, CAST(count(hit.host) AS BIGINT) AS n_entries,
    coalesce(string_agg(DISTINCT hit.list, ',' ORDER BY hit.list), '') AS lists, arg_max(hit.host, length(hit.host)) AS listed_host
FROM p LEFT JOIN hit ON p.page_id = hit.page_id GROUP BY p.page_id"""


@query
def op7_token_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document is inserted with its whole text's counts; a tenth is then deleted, and a fifth recounted under another source."""
    docs = table(spark, folder, "documents")
    counted = docs.select("doc_id", "source", "lang", F.explode(F.array(
        F.struct(F.lit("words-1").alias("tokenizer"), token_rollup.count_words(F.col("text")).alias("n")),
        F.struct(F.lit("marks-1").alias("tokenizer"), token_rollup.count_marks(F.col("text")).alias("n")))).alias("c"))
    fate = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 10
    image = lambda source, n: F.struct(source.alias("source"), "lang", F.col("c.tokenizer").alias("tokenizer"), n.alias("n_tokens"))
    first = image(F.col("source"), F.col("c.n"))
    moved = image(F.concat(F.lit("moved-"), "source"), F.col("c.n") + 1)
    step = lambda batch, old, new: F.struct(F.lit(batch).cast("long").alias("batch"), old.alias("old"), new.alias("new"))
    steps = F.array(step(1, F.when(F.lit(False), first), first), F.when(fate == 0, step(2, first, F.when(F.lit(False), first))),
                    F.when(fate.isin(1, 2), step(3, first, moved)))
    changes = counted.select(F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s")).select("s.*")
    path = fresh_path(spark, "rollup")
    token_rollup.apply(path, changes)
    token_rollup.apply(path, changes.filter("batch = 3"))  # delivered twice, counted once
    return token_rollup.totals(spark, path)


SQL["op7_token_rollup"] = r"""
WITH d AS (
    SELECT source, lang, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 10 AS fate,
        len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words,
        length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', 'a', 'g'), '[\x00-\x20\x7F]+', '', 'g')) AS marks
    FROM documents
), t AS (
    SELECT source, lang, fate, 'words-1' AS tokenizer, words AS n FROM d UNION ALL SELECT source, lang, fate, 'marks-1', marks FROM d
), c AS (
    SELECT 1 AS batch, source, lang, tokenizer, 1 AS docs, n FROM t
    UNION ALL SELECT 2, source, lang, tokenizer, -1, -n FROM t WHERE fate = 0
    UNION ALL SELECT 3, source, lang, tokenizer, -1, -n FROM t WHERE fate IN (1, 2)
    UNION ALL SELECT 3, 'moved-' || source, lang, tokenizer, 1, n + 1 FROM t WHERE fate IN (1, 2)
)
SELECT source, lang, tokenizer, CAST(sum(docs) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(count(DISTINCT batch) AS BIGINT) AS n_batches
FROM c GROUP BY ALL"""


@query
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.score(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return found.select("doc_id", "toxicity.*")


@query
def op12_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(table(spark, folder, "embeddings")).withColumnRenamed("key", "vec_id")


def _centroid_sql(rounds: int) -> str:
    near = """a{i} AS MATERIALIZED (
    SELECT vec_id, cluster, distance FROM (
        SELECT v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance,
            row_number() OVER (PARTITION BY v.vec_id ORDER BY sum((v.x - c.x) * (v.x - c.x)), c.cluster) AS place
        FROM v JOIN c{i} AS c USING (d) GROUP BY v.vec_id, c.cluster) WHERE place = 1)"""
    move = """c{j} AS MATERIALIZED (
    SELECT c.cluster, c.d, CASE WHEN n.n IS NULL THEN c.x ELSE (n.s - ((n.s % n.n) + n.n) % n.n) // n.n END AS x
    FROM c{i} AS c LEFT JOIN (
        SELECT a.cluster, v.d, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n FROM a{i} AS a JOIN v USING (vec_id) GROUP BY ALL) AS n USING (cluster, d))"""
    steps = [x.format(i=i, j=i + 1) for i in range(rounds) for x in (near, move)] + [near.format(i=rounds)]
    return f"""
WITH kept AS (
    SELECT vec_id, embedding FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
    SELECT vec_id, unnest(range(64)) AS d, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept
), s AS (
    SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster FROM kept ORDER BY cluster LIMIT 8
), c0 AS MATERIALIZED (SELECT s.cluster, v.d, v.x FROM s JOIN v USING (vec_id)),
{", ".join(steps)},
h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
    CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN h USING (cluster)"""


SQL["op12_centroid_clustering"] = _centroid_sql(10)


@query
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL["op13_source_divergence"] = rf"""
WITH d AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
t AS (
    SELECT lang, source, term, sum(n) AS n, count(*) AS docs FROM (
        SELECT lang, source, term, count(*) AS n FROM (SELECT row_number() OVER () AS r, lang, source, unnest(terms) AS term FROM d) GROUP BY r, lang, source, term)
    GROUP BY ALL
), k AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (
    SELECT g.lang, g.source, k.term, coalesce(t.n, 0) AS n, k.n AS n_lang, v.v, v.n AS t_lang
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term
), p AS (
    SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS HUGEINT) AS p,
        CAST(1 + (1000000000::HUGEINT * (n_lang + 2)) // (t_lang + 2 * v) AS HUGEINT) AS q
    FROM c
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts) WHERE part = 'pair' OR rank <= 10"""
