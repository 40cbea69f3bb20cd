"""Personal data: fixed patterns, and further spans found by weak supervision. DataFrame functions only.

Base spans are the matches of four patterns that pass their checks. Further candidates are written-out addresses, numbers
without a country code, and values that follow a colon or an equals sign, which may be secrets. Labelers vote on every span, base or
candidate: a pattern labeler (strict shape), a gazetteer labeler (endings, prefixes, years, names of secrets), a context labeler (words
before it) and a size labeler. Expectation-maximisation on the counts of
vote patterns estimates each labeler's reliability per kind without labels; its probabilities train a logistic span
classifier on shape features, which alone decides on the candidates. What leaves the executors is the count of each distinct vote or feature
pattern, whose number is bounded by the labelers and the feature ranges, and a few sums per round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..streaming.storage import stored

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the classifier can accept come after those with base patterns.
EVERY_KIND = (*KINDS, "secret")
#: A run of characters that cannot match as a whole cannot match from its middle: a match starts where a run starts, or where
#: the last match ended. Each text is then read once, however long its runs are.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Only texts with this can match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OTHER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?(?:\(at\)|\[at\]|\{at\}) ?| at )[A-Za-z0-9-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot )[A-Za-z0-9-]++)++",
    "secret": r"(?<=[:=]\x20?[\"'])[^\"'\s]{8,512}(?=[\"'])|(?<=[:=]\x20?)[A-Za-z0-9_/+.=-]{8,512}+",
    "phone": r"(?<![0-9A-Za-z+.,/-])(?:\(0?[0-9]{2,4}\) ?|0[0-9]{1,4}[ /.-])?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}(?![0-9A-Za-z])",
}
#: Fixed lists of the gazetteer and context labelers.
ENDINGS = "com|org|net|edu|gov|info|biz|io|co|uk|de|fr|es|it|eu|ch|at|nl|us"
NEAR = {
    "email": "mail|contact|kontakt|correo|courriel|adresse|address|write to|schreib|escrib",
    "phone": "tel|phone|call|fax|mobil|anruf|ruf|llam|appel|whatsapp|hotline",
    "ip": r"\bip\b|server|host|address|login",
    "card": "card|karte|carte|tarjeta|visa|master|amex|credit|kredit",
    "secret": "secret|token|passw|pwd|credential|private|geheim|kennwort|contrase|clave|jeton|mot de passe|login|auth",
}
#: Names that a secret is assigned to.
NAMES = r"(?:token|secret|passw(?:or)?d|passwort|pwd|(?:api|access|private|auth|secret)[_ -]?key|bearer|credentials?|kennwort|contraseña|clave)[_a-z0-9]*[\"']?\x20?[:=]\x20?[\"']?$"
AWAY = r"isbn|issn|page|seite|version|price|preis|prix|year|jahr|score|\bno\.|\bnr\.|\blines?\b|[$€£]"
LABELERS = ("pattern", "gazetteer", "context", "size")
FEATURES = ("digits", "marks", "length", "bracket", "at_sign", "near", "away", "leading", "named", "mixed")


def spans_of(text: Column, pattern: str) -> Column:
    """Matches of a pattern as structs ``at``, ``end`` (code points), ``match`` and ``before``, the text in front.

    The pieces between matches and the matches themselves come from two linear scans; places are running lengths.
    """
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(
        F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), m.alias("match"), F.right(p, F.lit(32)).alias("before")))
    start = F.struct(F.lit(0).cast("long").alias("place"), F.array().cast(
        "array<struct<at:bigint,end:bigint,match:string,before:string>>").alias("out"))
    return F.aggregate(both, start, lambda a, x: F.struct((a["place"] + x["gap"] + x["size"]).alias("place"), F.array_append(a["out"], F.struct(
        (a["place"] + x["gap"]).alias("at"), (a["place"] + x["gap"] + x["size"]).alias("end"), x["match"], x["before"])).alias("out")),
        lambda a: a["out"])


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def valid(kind: str, match: Column) -> Column:
    """The check of a base match."""
    n = F.length(_digits(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda x: x.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"))
    if kind == "card":
        return n.between(16, 19) & F.call_function("luhn_check", _digits(match))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _described(s: Column, kind: str, base: bool) -> Column:
    """A span with its votes (1, 0, abstaining null) and its features (small whole numbers)."""
    m, near_text = s["match"], F.lower(s["before"])
    digits, letters = F.length(_digits(m)), F.lower(m)
    near, away = near_text.rlike(NEAR[kind]), near_text.rlike(AWAY)
    sure = lambda yes, no: F.when(yes, F.lit(1)).when(no, F.lit(0))
    if kind == "email":
        ending = letters.rlike(rf"(?:\.|dot[)\]}}]? ?)(?:{ENDINGS})$")
        votes = (sure(m.contains("@") | m.rlike(r"[(\[{]at[)\]}]"), ~m.rlike("@|[(\\[{]")), sure(ending, ~ending),
                 sure(near, away), sure(letters.rlike("[.t ][a-z]{2,6}$"), letters.rlike("[0-9]$")))
    elif kind == "ip":
        votes = (F.lit(1), sure(~m.rlike("^(?:0|255)\\."), m.rlike("^(?:0|255)\\.")), sure(near, away), sure(F.length(m) >= 9, F.length(m) < 8))
    elif kind == "card":
        votes = (F.lit(1), sure(m.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), m.rlike("^[0189]")), sure(near, away), sure(digits == 16, digits > 17))
    elif kind == "secret":
        mixed = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
        votes = (sure(m.rlike("^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|[A-Za-z0-9_/+.=-]{20,})$") & mixed, ~mixed), sure(near_text.rlike(NAMES), near_text.rlike(r"https?[:=]|\d[:=]$")),
                 sure(near, away), sure(F.length(m) >= 20, F.length(m) < 12))
    else:
        years = m.rlike(r"(?:^|[ .-])(?:19|20)[0-9]{2}(?:$|[ .-])")
        votes = (sure(m.rlike(r"^(?:\+|\(|0)"), digits < 7), sure(m.rlike(r"^(?:\+|00|0[1-9])"), years), sure(near, away),
                 sure(digits.between(9, 13), (digits < 8) | (digits > 15)))
    features = (F.least(digits, F.lit(20)), F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(12)), F.least(F.length(m), F.lit(40)),
                m.rlike(r"[(\[{]").cast("int"), m.contains("@").cast("int"), near.cast("int"), away.cast("int"), m.rlike("^[+0(]").cast("int"),
                near_text.rlike(NAMES).cast("int"), (m.rlike("[0-9]") & m.rlike("[A-Za-z]")).cast("int"))
    return F.struct(
        F.lit(kind).alias("kind"), s["at"].alias("at"), s["end"].alias("end"), F.lit(base).alias("base"),
        F.struct(*[v.cast("int").alias(n) for v, n in zip(votes, LABELERS)]).alias("votes"),
        F.struct(*[F.coalesce(f, F.lit(0)).cast("int").alias(n) for f, n in zip(features, FEATURES)]).alias("shape"))


def _check(kind: str):
    return lambda s: valid(kind, s["match"])


def _describe(spans: Column, kind: str, base: bool) -> Column:
    return F.transform(spans, lambda s: _described(s, kind, base))


def only(spans: Column, kind: str) -> Column:
    """The spans of one kind."""
    return F.filter(spans, lambda s: s["kind"] == kind)


def _marked(docs: DataFrame, text: str) -> DataFrame:
    """The rows as ``_doc`` with ``_base`` and ``_other`` spans, stored: every text is scanned once."""
    t = F.coalesce(docs[text], F.lit(""))
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), t.alias("_t"))
    none = F.array().cast("array<struct<at:bigint,end:bigint,match:string,before:string>>")
    digit = F.col("_t").rlike("[0-9]")
    columns = {}
    for k in KINDS:
        may = digit if NEEDS[k] is None else F.contains("_t", F.lit(NEEDS[k])) & (digit if k != "email" else F.lit(True))
        columns[f"_b_{k}"] = F.when(may, spans_of(F.col("_t"), BASE[k])).otherwise(none)
    columns["_o_email"] = F.when(F.col("_t").rlike(r"[(\[{]at[)\]}]| at [^ ]+(?:\.| dot | ?[(\[{]dot)[^ \n]"), spans_of(F.col("_t"), OTHER["email"])).otherwise(none)
    columns["_o_secret"] = F.when(F.col("_t").rlike(r"[:=]\x20?[\"']?[A-Za-z0-9_/+.=-]{8}"), spans_of(F.col("_t"), OTHER["secret"])).otherwise(none)
    columns["_o_phone"] = F.when(F.col("_t").rlike("[0-9][0-9][ .)-]"), spans_of(F.col("_t"), OTHER["phone"])).otherwise(none)
    wide = wide.select("_doc", *[c.alias(n) for n, c in columns.items()])
    base = F.concat(*[_describe(F.filter(f"_b_{k}", _check(k)), k, True) for k in KINDS])
    other = F.concat(*[_describe(F.col(f"_o_{k}"), k, False) for k in OTHER])
    wide = wide.select("_doc", base.alias("_base"), other.alias("_other"))
    # A number inside a secret does not hide it.
    hides = lambda b, o: (b["at"] < o["end"]) & (b["end"] > o["at"]) & ((o["kind"] != "secret") | b["kind"].isin("email", "ip"))
    clear = F.filter("_other", lambda o: ~F.exists("_base", lambda b: hides(b, o)))
    return stored(wide.withColumn("_other", clear), "spans")


def reliabilities(votes: DataFrame, tolerance: float = 1e-4) -> dict[str, tuple[float, list[float], list[float]]]:
    """Expectation-maximisation over counted vote patterns (``kind``, labelers, ``n``): per kind the share of true spans, and each
    labeler's chance of a yes on true and on false spans. Ends when no estimate moves by more than ``tolerance``.

    Spark counts; the rounds then run over at most 3 ** 4 distinct patterns a kind, however many spans there are, and start no jobs.
    """
    patterns: dict[str, list[tuple[tuple, int]]] = {}
    for r in votes.groupBy("kind", *LABELERS).agg(F.sum("n").alias("n")).collect():
        patterns.setdefault(r.kind, []).append((tuple(r[v] for v in LABELERS), r.n))
    for counted in patterns.values():  # sums don't depend on the order in which rows arrive
        counted.sort(key=lambda x: [-1 if v is None else v for v in x[0]])
    now = {k: (0.5, [0.8] * len(LABELERS), [0.2] * len(LABELERS)) for k in patterns}
    moved = 1.0
    while now and moved > tolerance:
        new = {k: _round(counted, *now[k]) for k, counted in patterns.items()}
        moved = max(abs(a - b) for k in new for a, b in zip([new[k][0], *new[k][1], *new[k][2]], [now[k][0], *now[k][1], *now[k][2]]))
        now = new
    return now


def _round(counted: list[tuple[tuple, int]], share: float, yes: list[float], no: list[float]) -> tuple[float, list[float], list[float]]:
    """One round over the patterns of a kind. Add-one smoothing towards better than chance keeps labelers apart."""
    true = 0.0
    said = [[0.0, 0.0] for _ in LABELERS]  # weight of a yes, on true and on false spans
    voted = [[0.0, 0.0] for _ in LABELERS]
    for votes, n in counted:
        odds = math.log(share / (1 - share))
        for v, y, f in zip(votes, yes, no):
            odds += 0.0 if v is None else math.log(y / f) if v == 1 else math.log((1 - y) / (1 - f))
        p = 1 / (1 + math.exp(-odds))
        true += p * n
        for i, v in enumerate(votes):
            for side, weight in enumerate((p * n, (1 - p) * n)):
                if v is not None:
                    voted[i][side] += weight
                if v == 1:
                    said[i][side] += weight
    yes, no = ([(said[i][side] + w) / (voted[i][side] + 5) for i in range(len(LABELERS))] for side, w in ((0, 4), (1, 1)))
    return (true + 1) / (sum(n for _, n in counted) + 2), yes, no


def probability(estimates: dict) -> Column:
    """Chance that a span is true, from its votes."""
    out = F.lit(0.5)
    for kind, (share, yes, no) in estimates.items():
        odds = F.lit(math.log(share / (1 - share)))
        for v, y, n in zip(LABELERS, yes, no):
            odds = odds + F.when(F.col(v) == 1, math.log(y / n)).when(F.col(v) == 0, math.log((1 - y) / (1 - n))).otherwise(0.0)
        out = F.when(F.col("kind") == kind, 1 / (1 + F.exp(-odds))).otherwise(out)
    return out


def classifier(spans: DataFrame, regularisation: float = 0.01) -> dict[str, float]:
    """Weights of a logistic span classifier trained on the labelers' probabilities; empty without spans.

    Each distinct feature pattern enters twice, as true and as false, weighted by its summed probabilities.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    counted = stored(spans.groupBy("kind", *LABELERS, *FEATURES).agg(F.count(F.lit(1)).alias("n")), "patterns")
    estimates = reliabilities(counted)
    if not estimates:
        return {}
    names = [*FEATURES, *[f"is_{k}" for k in EVERY_KIND]]
    soft = counted.withColumn("p", probability(estimates)).groupBy("kind", *FEATURES).agg(
        F.sum(F.col("p") * F.col("n")).alias("t"), F.sum((1 - F.col("p")) * F.col("n")).alias("f"))
    total = soft.agg(F.sum(F.col("t") + F.col("f"))).first()[0]
    rows = soft.withColumns({f"is_{k}": (F.col("kind") == k).cast("double") for k in EVERY_KIND}).select(
        *names, F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("t").alias("w")), F.struct(F.lit(0.0).alias("y"), F.col("f").alias("w")))).alias("e"))
    rows = VectorAssembler(inputCols=names, outputCol="x").transform(rows).select("x", "e.y", (F.col("e.w") / total).alias("w"))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=regularisation).fit(rows)
    return dict(zip(names, model.coefficients.toArray().tolist())) | {"": model.intercept}


def _score(s: Column, weights: dict[str, float]) -> Column:
    total = F.lit(weights[""])
    for n in FEATURES:
        total = total + weights[n] * s["shape"][n]
    for k in EVERY_KIND:
        total = total + F.when(s["kind"] == k, weights[f"is_{k}"]).otherwise(0.0)
    return total


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the struct ``pii``: ``base`` and ``spans``, arrays of (kind, start, end) in code points, by kind, then start.

    All base spans are among ``spans``; texts may be of any length. Null and empty texts have none; a table without any trains nothing; repeated rows are
    judged alike. All columns stay; only the name ``pii`` is replaced.
    """
    marked = _marked(docs, text)
    spans = marked.select(F.explode(F.concat("_base", "_other")).alias("s")).select("s.kind", "s.votes.*", "s.shape.*")
    weights = classifier(spans)
    plain = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["at"].alias("start"), s["end"].alias("end")))
    more = F.filter("_other", lambda s: _score(s, weights) > 0) if weights else F.filter("_other", lambda s: F.lit(False))
    together = F.concat("_base", more)
    every = F.concat(*[F.array_sort(plain(only(together, k))) for k in EVERY_KIND])
    return marked.select(*[F.col("_doc")[c].alias(c) for c in docs.columns if c != "pii"], F.struct(plain(F.col("_base")).alias("base"), every.alias("spans")).alias("pii"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every span replaced by its kind in angle brackets, overlapping spans by the first one's; ``n_chars`` follows if present."""
    found = find(docs.withColumnRenamed("pii", "_pii"), text)
    t = F.col(text)
    order = F.array_sort(F.transform("pii.spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("place"), F.array().cast("array<string>").alias("out"))
    parts = F.aggregate(order, start, lambda a, s: F.when(s["start"] >= a["place"], F.struct(
        s["end"].alias("place"), F.concat(a["out"], F.array(
            F.substring(t, (a["place"] + 1).cast("int"), (s["start"] - a["place"]).cast("int")),
            F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).alias("out"))).otherwise(
                F.struct(F.greatest(a["place"], s["end"]).alias("place"), a["out"].alias("out"))),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, (a["place"] + 1).cast("int"), F.length(t))))
    out = found.withColumn(text, F.when(F.size("pii.spans") > 0, parts).otherwise(t)).drop("pii").withColumnRenamed("_pii", "pii")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)
