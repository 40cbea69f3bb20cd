"""Source divergence: whole results against the definition, term by term and pair by pair."""

import random
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("panelforge.llm")
from panelforge.llm import divergence  # noqa: E402

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHAPE = "doc_id long, text string, lang string, source string, value string, rank int"


def plain(rows, least=10, top=10):
    """The definition over (text, lang, source) rows."""
    lower = str.maketrans(UPPER, UPPER.lower())
    uses, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in [[x or "" for x in r] for r in rows]:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        uses[lang, source].update(words)
        seen[lang].update(set(words))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in seen[lang].items() if n >= least}
        v = len(kept)
        whole = Counter()
        for s in sources:
            whole.update({t: n for t, n in uses[lang, s].items() if t in kept})

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (total + 2 * v) for t in kept}

        p, q = {s: shares(uses[lang, s]) for s in sources}, shares(whole)
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(apart(p[s][t], q[t]), t) for t in kept if uses[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], SHAPE)


def audited(spark, rows, **options):
    return sorted(tuple(r) for r in divergence.audit(frame(spark, rows).repartition(6), **options).collect())


def words(r, n):
    return " ".join(r.choice(["a", "B", "cc", "Été", "d1e", "naïve", "z_z", "日本", "e'f", "ÀB"]) * r.randint(1, 2) for _ in range(n))


@pytest.mark.parametrize("held", [200_000, 5])
def test_whole_result(spark, held):
    r = random.Random(8)
    rows = [(words(r, r.randint(0, 40)), r.choice(["en", "en", "en", "fr", None]), r.choice(["hot"] * 6 + ["s1", "s2", "S3", None, ""])) for _ in range(300)]
    rows += [(None, "en", "silent"), ("", "en", "silent"), ("rare words only", "xx", "one"), ("", "xx", "two"), ("a " * 30_000, "fr", "s1")]
    rows += rows[:20]  # repeated rows count again
    assert audited(spark, rows, held=held) == plain(rows)


def test_shared_paths_and_multiplicities(spark):
    # Forty terms stand in the same two sources with the same counts: one path, forty rows through it.
    common = " ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    rows = [(common, "en", s) for s in ("a", "b") for _ in range(6)] + [(common + " tail", "en", "c")] * 10
    assert audited(spark, rows) == plain(rows)


def test_no_rows_and_no_terms(spark):
    assert audited(spark, []) == []
    assert audited(spark, [("1 2 3", "en", "a"), (None, "en", "b")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_kept_terms_and_top_are_parameters(spark):
    rows = [("x y y z", "en", "a"), ("x w", "en", "b"), ("y w w", "en", "b")]
    assert audited(spark, rows, least_docs=1, top=2) == plain(rows, 1, 2)
