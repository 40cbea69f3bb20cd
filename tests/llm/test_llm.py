"""The text operators against brute force on small fixtures: nulls, empty and long texts, repeats, ties, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("panelforge.llm")
from pyspark.sql import functions as F  # noqa: E402

from panelforge.llm import (  # noqa: E402
    decontaminate, fm_index, near_dedup, pieces, pii, quality, queries, sharding, substring_dedup, token_records, token_rollup, url_lists,
)
from panelforge.streaming.storage import fresh_path  # noqa: E402

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits int, quality int, pii int, pieces int, shard int"


def corpus():
    r = random.Random(3)
    prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    passage, long = prose(60), prose(4000)
    texts = [None, "", " \t\n", "one", "one", "x" * 5000, long, long, long + " tail"]
    texts += [f"{prose(r.randint(0, 40))} {passage} {prose(r.randint(0, 40))}" for _ in range(8)]
    texts += [prose(80) for _ in range(30)] + ["a b c " * 60, "écrire à a@b.co\n+1 (499) 555-6503 x 😀 10.0.0.256 1.2.3.4, 4111 1111 1111 1111 z"]
    near = prose(300).split()
    texts += [" ".join(near[:i] + ["changed"] + near[i + 1:]) for i in range(0, 300, 40)] + [" ".join(near)] * 2
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 2], None, 1, 2, 3, 4, 5) for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, passage, None, None, 1, 1, 1, 1, 1, 1)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_personal_data(docs, rows, empty):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    good = {"email": lambda m, d: True, "ip": lambda m, d: all(int(x) < 256 for x in m.split(".")), "card": lambda m, d: 16 <= len(d) <= 19 and
            sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0, "phone": lambda m, d: 8 <= len(d) <= 15}
    r = random.Random(9)
    odd = ["".join(r.choice(["a", "@", ".", "b.c", "1", "23", " ", "-", "+", "(", "255.", "é", "_", "4111111111111111"]) for _ in range(25)) for _ in range(300)]
    frame = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    for row in pii.find(frame).collect():
        t = row.text or ""
        want = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, t) if good[k](m[0], re.sub("[^0-9]", "", m[0]))]
        assert [tuple(s) for s in row.pii.base] == want
        assert set(want) <= {tuple(s) for s in row.pii.spans}
    assert pii.find(empty).count() == 0
    masked = pii.redact(docs)
    assert masked.columns == docs.columns
    text = next(x.text for x in masked.collect() if x.text and "écrire" in x.text)
    assert text == "écrire à <EMAIL>\n<PHONE> x 😀 10.0.0.256 <IP>, <CARD> z"


def test_reliabilities_tell_labelers_apart(spark):
    r, rows = random.Random(1), []
    for _ in range(2000):
        true = r.random() < 0.4
        rows.append(("phone", *[int(true if r.random() < a else not true) for a in (0.95, 0.9, 0.6, 0.85)], 1))
    votes = spark.createDataFrame(rows, "kind string, pattern int, gazetteer int, context int, size int, n int")
    share, yes, no = pii.reliabilities(votes)["phone"]
    assert abs(share - 0.4) < 0.06 and abs(yes[0] - 0.95) < 0.06 and abs(yes[2] - 0.6) < 0.08 and abs(no[1] - 0.1) < 0.06


def test_reliabilities_take_one_query_however_many_rounds(spark):
    votes = spark.createDataFrame([("phone", 1, None, 0, 1, 5), ("phone", 0, 1, None, 0, 9), ("email", 1, 1, 1, 0, 4), ("phone", 1, None, 0, 1, 2)],
                                  "kind string, pattern int, gazetteer int, context int, size int, n int")
    spark.sparkContext.setJobGroup("rounds", "")
    try:
        few, many = (pii.reliabilities(votes, t) for t in (1.0, 1e-9))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert set(few) == set(many) == {"email", "phone"} and few != many
    assert len(jobs) <= 6
    assert pii.reliabilities(votes.limit(0)) == {}


def test_quality(docs, rows, empty):
    judged = {r.doc_id: r.quality for r in quality.assess(docs).collect()}
    assert "quality" in quality.assess(docs).columns and quality.assess(empty).count() == 0
    for row in rows[:-2]:
        t, q = row[1] or "", judged[row[0]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        triples = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        hit = {i + j for i, x in enumerate(triples) if triples.count(x) > 1 for j in range(3)} if len(w) < 900 else None
        assert (q.n_words, q.word_chars, q.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert hit is None or q.n_repeat_words == len(hit)
        assert q.base_failed == (len(w) < 50 or 100 * q.n_repeat_words > 50 * len(w)) and (not q.kept or not q.base_failed)
    assert quality.keep_good(docs).columns == docs.columns


def test_outliers_are_found_among_many(spark):
    r = random.Random(4)
    data = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(60, 300))), "en", "s") for i in range(400)]
    data += [(1000 + i, " ".join(r.choice(WORDS) + "###" for _ in range(150)), "en", "s") for i in range(60)]
    kept = {x.doc_id: x.quality.kept for x in quality.assess(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(400)) and not any(kept[1000 + i] for i in range(60))
    assert abs(quality.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3


@pytest.mark.parametrize("bucket", [4096, 2])
def test_near_copies(spark, bucket):
    r = random.Random(8)
    base, texts = [r.choice(WORDS) for _ in range(120)], []
    for _ in range(60):
        base = [*base]
        base[r.randrange(120)] = "z"
        texts.append(" ".join(base))
    texts += [None, "", " ", "one", "ONE", *texts[:3]]
    rows = [(i if i % 5 else -i, t) for i, t in enumerate(texts)]
    got = {x.key: (x.fp, x.component) for x in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket).collect()}
    fp = [near_dedup.simhash(t.encode() if t is not None else None) for _, t in rows]
    root = {k: k for k, _ in rows}
    tied = [(a, b) for i, (a, _) in enumerate(rows) for j, (b, _) in enumerate(rows) if ((fp[i] ^ fp[j]) & (1 << 64) - 1).bit_count() <= 4]
    for _ in rows:
        for a, b in tied:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: (fp[i], root[k]) for i, (k, _) in enumerate(rows)}


def test_keep_one(docs, empty):
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and near_dedup.keep_one(empty).count() == 0
    ids = [x.doc_id for x in kept.collect()]
    assert len(ids) == len(set(ids)) and {0, 3, 6} <= set(ids) and not {1, 2, 4, 7} & set(ids)


@pytest.mark.parametrize("most", [32 << 20, 300])
def test_decontamination(spark, docs, rows, most):
    passage = rows[-1][1].split()
    tests = [(1, " ".join(passage[5:30]).upper()), (2, "one"), (3, None), (4, "..."), (5, " ".join(passage[20:35])), (10, " ".join(WORDS[:12])), (2, "w399 w398")]
    bench = spark.createDataFrame(tests, "item_id long, text string")
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for x in decontaminate.contamination(docs, bench, most_bytes=most).collect():
        w, hit, items = fold(x.text), set(), set()
        for item, t in tests:
            v = fold(t)
            for p in {tuple(v[i:i + 10]) for i in range(max(1, len(v) - 9))} if v else ():
                for i in range(len(w) - len(p) + 1):
                    if tuple(w[i:i + len(p)]) == p:
                        hit |= set(range(i, i + len(p)))
                        items.add(item)
        assert (x.hits.n_words, x.hits.n_hit, x.hits.items) == (len(w), len(hit), sorted(items))
        assert sum(len(fold(x.text[s.start:s.end])) for s in x.hits.spans) == len(hit)
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


@pytest.mark.parametrize("hot,shard", [(1024, 1 << 19), (1, 200)])
def test_substring_dedup(docs, rows, empty, hot, shard):
    held, want = {}, {}
    for k, t, *_ in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - 49):
            x = tuple(w[i:i + 50])
            held[x] = min(k, held.get(x, k)) if k is not None else held.get(x, 1 << 60)
    for k, t, *_ in rows:
        w = (t or "").encode().split()
        gone = {j for i in range(len(w) - 49) if k is not None and held[tuple(w[i:i + 50])] < k for j in range(i, i + 50)}
        want[k] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    got = substring_dedup.remove_repeats(docs, hot=hot, shard_words=shard).collect()
    assert len(got) == len(rows) and {x.key: (x.n_words, x.n_removed, x.kept_sha256) for x in got} == want
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("length", [2, 3, 4, 5, 8, 9])
def test_matching_statistics(length):
    r = random.Random(length)
    for _ in range(25):
        seqs = [[r.choice("abc") for _ in range(r.randint(0, 14))] for _ in range(r.randint(1, 8))]
        values = np.array([r.randint(0, 50) for _ in seqs])
        asked = seqs + [[r.choice("abcd") for _ in range(r.randint(0, 20))] for _ in range(6)]
        for q, g in zip(asked, fm_index.FMIndex(seqs, values, length).statistics(asked)):
            for i in range(max(0, len(q) - length + 1)):
                owners = [int(v) for s, v in zip(seqs, values) if any(s[j:j + length] == q[i:i + length] for j in range(len(s) - length + 1))]
                assert min(owners, default=fm_index.NONE) == g[i]


def odd_texts():
    r = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "▁", "é", "漢", "😀", "　", "\xa0", "\x85", "'s", "23", "!", "...", "<s>", "<0x41>",
             "<|endoftext|>", "\x00", "\x1c", "ing", "​", "***"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(800)] + ["a" * 20000, " " * 500, ""]


def test_pieces(spark, docs, folder):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto = f.read()
    odd = spark.createDataFrame([(t,) for t in odd_texts()] + [(None,)], "text string")
    assert pieces.against_library(odd, proto).count() == 0 and pieces.against_library(docs, proto).count() == 0
    assert pieces.against_library(spark.read.parquet(f"{folder}/documents.parquet"), proto).count() == 0
    assert pieces.pieces(docs, proto).columns == [c for c in docs.columns if c != "pieces"] + ["pieces"]
    library, model, r = SentencePieceProcessor(model_proto=proto), pieces.Model(proto), random.Random(2)
    for _ in range(500):
        ids = [r.randrange(32000) if r.random() < 0.5 else r.randrange(300) for _ in range(r.randint(1, 9))]
        assert model.decode(np.array(ids)) == library.decode(ids)


def test_records(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    spec = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    library = Tokenizer.from_str(spec)
    library.encode_special_tokens = True
    texts = odd_texts()
    assert token_records.Encoder(spec).encode(texts) == [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    place = fresh_path(spark, "records")
    written = token_records.write(docs, place, spec)
    back = token_records.read(written.repartition(3), place).collect()  # shuffled
    order = sorted(((k is not None, k or 0, t or "") for k, t, *_ in rows))
    at, want = 0, []
    for known, k, t in order:
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        want.append((k if known else None, at, ids))
        at += len(ids)
    assert sorted(((x.key, x.start, x.ids) for x in back), key=lambda x: x[1]) == want
    raw = token_records.read(written, place, raw=True).filter("key = 3").withColumn("c", F.crc32("ids")).first()
    assert raw.c == zlib.crc32(np.array(next(w[2] for w in want if w[0] == 3), "<u4").tobytes())
    assert token_records.write(empty, fresh_path(spark, "records"), spec).count() == 0
    record = bytearray(token_records.frame(b"payload"))
    assert token_records.unframe(bytes(record)) == b"payload"
    record[14] ^= 1
    with pytest.raises(ValueError):
        token_records.unframe(bytes(record))


def test_sharding(spark, docs, empty):
    out = sharding.assign(docs, 9000)
    rows = out.collect()
    assert len(rows) == docs.count() and sharding.assign(empty, 10).count() == 0
    for name in {x.shard.name for x in rows}:
        own = [x for x in rows if x.shard.name == name]
        size = sum(len((x.text or "").encode()) for x in own)
        assert own[0].shard.rows == len(own) and own[0].shard.bytes == size and (size <= 9000 or len(own) == 1)
    same = spark.createDataFrame([(1, "abcd")] * 50, "doc_id long, text string")  # bits cannot part them
    assert all(x.shard.bytes <= 20 for x in sharding.assign(same, 20).collect())


def test_url_lists(spark):
    e = [("a", "bad.example", "2024-01-10", True), ("a", "bad.example", "2024-03-01", False), ("a", "bad.example", "2024-02-01", True), ("b", "x.bad.example", "2024-02-15", True),
         ("b", "X.bad.example", "2024-02-15", False), ("b", "other.org", "2023-05-05", True), (None, "other.org", "2020-01-01", True)]
    c = [("http://x.bad.example:80/p", "2024-01-09"), ("http://x.bad.example", "2024-01-10"), ("http://BAD.example.", "2024-02-29"), ("http://bad.example/", "2024-03-01"),
         ("https://u@other.org", "2030-01-01"), ("nonsense", "2024-02-01"), (None, "2024-02-01"), ("http://other.org", None), ("https://u@other.org", "2030-01-01")]
    entries = spark.createDataFrame(e, "list string, host string, at string, added boolean").withColumn("at", F.col("at").cast("timestamp"))
    captures = spark.createDataFrame([(i, *x) for i, x in enumerate(c)], "page_id int, url string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    got = [x.verdict.blocked for x in url_lists.evaluate(captures, entries).orderBy("page_id").collect()]
    assert got == [False, True, True, False, True, False, False, False, True]
    assert url_lists.evaluate(captures.limit(0), entries).count() == 0 and url_lists.evaluate(captures, entries.limit(0)).filter("verdict.blocked").count() == 0


def test_rollup(spark):
    image = "struct<source:string,lang:string,tokenizer:string,n_tokens:long>"
    rows = [(1, None, ("s", "en", "t", 5)), (1, None, ("s", None, "t", 7)), (2, ("s", "en", "t", 5), ("r", "en", "t", 6)), (3, ("s", None, "t", 7), None), (3, None, ("s", "en", "t", None))]
    changes = spark.createDataFrame(rows, f"batch long, old {image}, new {image}")
    path = fresh_path(spark, "rollup")
    assert token_rollup.totals(spark, path).count() == 0
    token_rollup.apply(path, changes.filter("batch < 3"))
    token_rollup.apply(path, changes)  # batches 1 and 2 once more
    state = lambda p, **o: {(x.source, x.lang): (x.n_docs, x.n_tokens) for x in token_rollup.totals(spark, p, **o).collect()}
    assert state(path) == {("s", "en"): (1, 0), ("s", None): (0, 0), ("r", "en"): (1, 6)}
    assert state(path, upto=1) == {("s", "en"): (1, 5), ("s", None): (1, 7)}
    to = fresh_path(spark, "rollup")
    token_rollup.compact(spark, path, to)
    token_rollup.apply(to, changes)
    assert state(to) == state(path)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(name, spark, folder, con):
    from oracle import table

    df = queries.QUERIES[name](spark, folder)
    result = con.execute(queries.SQL[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in result.description], result.fetchall())
