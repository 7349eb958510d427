"""Personal data: fixed patterns, and overlapping candidates judged by boosted trees (operator 7)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .spans import equal, joined, overlapping, with_drawers, with_places

#: The base kinds in the order of the report. Possessive repeats and the look-behind change no match; they keep the
#: time linear in long runs of one class.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Generators of further candidates, by the kind that they propose: looser or narrower forms than the base patterns, which may overlap
#: each other and the base matches.
GENERATORS = {
    "email_spelt": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,63}+){1,8}+",
    "ip_part": r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card_run": r"(?<![0-9])[0-9]{13,19}(?![0-9])",
    "card_groups": r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])",
    "phone_parts": r"\+?[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
}
KINDS = ("email", "ip", "card", "phone", *GENERATORS)
_PARENT = {"email_spelt": 0, "ip_part": 1, "card_run": 2, "card_groups": 2, "phone_parts": 3}
#: Words before a candidate that speak for personal data of a kind, or against it.
CUES = (r"(?i)(mail|write|contact|reach|address)", r"(?i)(host|server|login|\bip\b|client|from)", r"(?i)(card|visa|master|amex|account|pay)",
        r"(?i)(phone|tel|call|fax|mobile|reach|contact)")
AGAINST = r"(?i)(order|invoice|version|release|serial|isbn|\bref|section|chapter|page|item|part|ticket|tracking|\bid\b|\bv$)"
#: Numbers that the issuers of payment cards give out begin like this, for 13 to 19 digits.
ISSUED = r"^(4[0-9]{12}([0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3(0[0-5]|[68][0-9])[0-9]{11}|6(011|5[0-9]{2})[0-9]{12,15})$"
#: Dates, with or without a time.
DATED = r"^([12][0-9]{3}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ][12][0-9]{3})"
NEAR = 24

FEATURES = ("kind", "length", "digits", "marks", "groups", "brackets", "spelt", "spaced", "issued", "dated", "top", "cue", "against", "joined_before", "joined_after", "digit_near")
#: The trees' size, and the groups of equal labelled candidates that one partition of the fit holds.
TREES, DEPTH, STEP, SEED, PART_ROWS = 8, 4, 0.4, 7, 1 << 16
#: A generator's threshold lies below the least score at which so many of the held-out labelled candidates at or above it are positive.
PRECISION = 0.98


def examples() -> list[tuple[str, float]]:
    """Labelled candidates made by rule: every kind's forms behind words that speak for it, against it, or of neither sort."""
    neither = ("", "and then the ", "which was ", "it says ", "near the old town ")
    against = ("order ", "invoice no. ", "version ", "serial number ", "see section ", "tracking id ", "ref: ", "item ")
    forms = {
        0: (("mail ", "write to ", "contact: ", "reach me at "), ["ann (at) example (dot) com", "j.doe[at]mail.example[dot]org", "kim (at) example.net", "lee@example (dot) co", "mia [at] example [dot] de"]),
        1: (("host ", "server at ", "login from ", "ip: "), ["10.0.0.7", "192.168.12.1", "97.51.17.173", "8.8.4.4"]),
        2: (("card ", "visa: ", "pay with account ", "my amex "), ["378282246310005", "4111 1111 1111 1111", "4222222222222", "5555-5555-5555-4444", "371449635398431", "6011111111111117"]),
        3: (("phone ", "tel. ", "call me: ", "fax ", "mobile "), ["555-123-4567", "(030) 555 1234", "1 555 123 4567", "555.123.4567", "017 555-7713", "44 20 7946 0958"])}
    plain = {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.0}
    made = []
    for kind, (fore, values) in forms.items():
        for value in values:
            made += [(f"{c}{value} today", 1.0) for c in fore] + [(f"{c}{value}, as said", plain[kind]) for c in neither] + [(f"{c}{value} again", 1.0 if kind == 0 else 0.0) for c in against]
    numbers = ["2024-01-15 1234-5678", "2024 01 15 123 4567", "12-30-2019 555-1234", "4000 123 4567", "100 200 300 400", "1234567890123", "7000000000000005", "9999 8888 7777 6666", "20240115 123 4567"]
    return made + [(f"{c}{value} again", 0.0) for c in (*neither, *against) for value in numbers]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    d = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(
        F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0)).alias("v"), ((n - i) % 2 == 1).alias("twice")))
    total = F.aggregate(d, F.lit(0), lambda acc, x: acc + F.when(x["twice"], F.when(x["v"] > 4, 2 * x["v"] - 9).otherwise(2 * x["v"])).otherwise(x["v"]))
    return (n > 0) & (total % 10 == 0)


def octets(m: Column) -> Column:
    """Whether four dotted numbers are all at most 255, leading zeros apart."""
    parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return (F.size(parts) == 4) & F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def _valid(kind: int, m: Column) -> Column:
    """The strict rule of a base kind."""
    n = F.length(_digits(m))
    return [m.contains("@"), octets(m), n.between(16, 19) & luhn(_digits(m)), m.startswith("+") & n.between(8, 15)][kind]


def _possible(parent: int, m: Column) -> Column:
    """What a candidate of a kind must be at least: numbers of a card pass the Luhn check, parts of an address fit a byte, a phone number has 7 to 15 digits."""
    n = F.length(_digits(m))
    return [F.lit(True), octets(m), n.between(13, 19) & luhn(_digits(m)), n.between(7, 15)][parent]


def _features(kind: int, parent: int, p: Column) -> Column:
    """Format and context of a candidate. What makes a base match of its kind (an at sign, a plus, a checksum, bytes) is none of them."""
    m = p["match"]
    flag = lambda c: c.cast("double")
    size = lambda c: F.length(c).cast("double")
    digits = _digits(m)
    fore = F.right(p["before"], F.lit(NEAR))
    return F.struct(
        F.lit(float(kind)).alias("kind"), size(m).alias("length"), size(digits).alias("digits"), size(F.regexp_replace(m, "[A-Za-z0-9]", "")).alias("marks"),
        F.size(F.split(m, "[^A-Za-z0-9]+")).cast("double").alias("groups"), flag(m.startswith("(")).alias("brackets"),
        flag(m.rlike(r"\((at|dot)\)|\[(at|dot)\]")).alias("spelt"), flag(m.contains(" ")).alias("spaced"), flag(digits.rlike(ISSUED)).alias("issued"), flag(m.rlike(DATED)).alias("dated"),
        size(F.regexp_extract(m, r"([A-Za-z]+)$", 1)).alias("top"), flag(fore.rlike(CUES[parent])).alias("cue"), flag(fore.rlike(AGAINST)).alias("against"),
        flag(F.right(p["before"], F.lit(1)).rlike("[A-Za-z0-9._+-]")).alias("joined_before"), flag(F.left(p["after"], F.lit(2)).rlike("^([A-Za-z0-9_-]|[.][0-9])")).alias("joined_after"),
        (flag(F.right(p["before"], F.lit(2)).rlike("[0-9]")) + flag(F.left(p["after"], F.lit(2)).rlike("[0-9]"))).alias("digit_near"))


def _found(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``row`` (the kept columns), ``same`` (a hash of the text), ``base`` spans, their ``drawers`` and ``cands``: spans with features."""
    df = docs.select(F.struct(*keep).alias("row") if keep else F.lit(0).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    df = df.withColumn("same", F.xxhash64("_text", F.lit(SEED)))
    base = {"_b0": EMAIL, "_b1": IP, "_b2": CARD, "_b3": PHONE}
    names = {f"_g{i}": p for i, p in enumerate(GENERATORS.values())}
    df = with_places(df, "_text", base | names).drop("_text")

    def spans(kind: int) -> Column:
        return F.transform(F.filter(f"_b{kind}", lambda p: _valid(kind, p["match"])),
                           lambda p: F.struct(F.lit(kind).alias("kind"), p["first"].alias("first"), p["past"].alias("past")))

    def candidates(i: int, parent: int) -> Column:
        def one(p):
            return F.struct(F.lit(4 + i).alias("kind"), p["first"].alias("first"), p["past"].alias("past"), _features(4 + i, parent, p).alias("f"))
        return F.transform(F.filter(f"_g{i}", lambda p: _possible(parent, p["match"])), one)

    df = df.select("row", "same", *names, F.sort_array(F.concat(*(spans(k) for k in range(4)))).alias("base"))
    df = with_drawers(df, "base")
    return df.select("row", "same", "base", "drawers", F.concat(*(candidates(i, _PARENT[k]) for i, k in enumerate(GENERATORS))).alias("cands"))


@dataclass(frozen=True)
class SpanModel:
    """Boosted trees as nested conditions over a candidate's features, and a threshold of the margin per kind (null: nothing passes)."""

    trees: list[tuple[float, tuple | float]]
    thresholds: dict[int, float]

    def margin(self, f: Column) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, limit, low, high = node
            return F.when(f[FEATURES[feature]] <= limit, walk(low)).otherwise(walk(high))

        return sum((F.lit(float(w)) * walk(t) for w, t in self.trees), F.lit(0.0))

    def accepts(self, c: Column) -> Column:
        least = F.lit(None).cast("double")
        for kind, t in self.thresholds.items():
            least = F.when(c["kind"] == kind, F.lit(float(t))).otherwise(least)
        return F.coalesce(self.margin(c["f"]) >= least, F.lit(False))


def _nested(node):
    """A fitted tree's node as (feature, limit, low side, high side) or a leaf's value."""
    if node.numDescendants() == 0:
        return node.prediction()
    s = node.split()
    return s.featureIndex(), s.threshold(), _nested(node.leftChild()), _nested(node.rightChild())


def _labelled(found: DataFrame, given: Column) -> DataFrame:
    """Candidates with a given label (source 0) or evidence (source 1), as rows of ``same``, ``kind``, ``label``, ``source``, ``f``, ``first`` and ``past``.

    A candidate equal to a base match behind a word that speaks for its kind is positive; one that is no base match and stands behind a word against
    it, or looks like a date, is negative. All others, candidates outside the base format among them, have no label and are left out.
    """
    parents = F.array(*(F.lit(k) for k in _PARENT.values()))
    telling = F.filter("cands", lambda c: F.col("given").isNotNull() | (c["f"]["cue"] == 1) | (c["f"]["against"] == 1) | (c["f"]["dated"] == 1))

    def marked(c):
        span = F.struct(c["first"].alias("first"), c["past"].alias("past"), F.element_at(parents, c["kind"] - 3).alias("kind"))
        return F.struct(c["kind"].alias("kind"), c["first"].alias("first"), c["past"].alias("past"), c["f"].alias("f"), equal(span, F.col("drawers")).alias("based"))

    # marked before the candidates become rows: a row must not carry all spans of its text
    found = found.withColumn("given", given)
    rows = found.select("given", "same", F.explode(F.transform(telling, marked)).alias("c")).select("given", "same", "c.*")
    doubt = (F.col("f.against") == 1) | (F.col("f.dated") == 1)
    label = F.when((F.col("f.cue") == 1) & ~doubt & F.col("based"), 1.0).when(doubt & (F.col("f.cue") == 0) & ~F.col("based"), 0.0)
    return rows.select("same", "kind", F.coalesce("given", label).alias("label"), F.col("given").isNull().cast("int").alias("source"), "f", "first", "past").where("label is not null")


def fit(found: DataFrame) -> SpanModel:
    """Trees fitted on labelled candidates, with a calibrated threshold per generator.

    ``found`` is a stored table of ``_found``. The labelled candidates are ``examples()``, made by rule, and all those of the whole corpus that have evidence (see ``_labelled``);
    those of equal texts count once, so copies do not outweigh the rest. Both sources weigh the same in all. Candidates of equal features and
    label are one row with their number as its weight, which is all that a tree looks at. A fifth of the candidates, by hash, calibrates. Rows are sorted, so a rerun fits the same trees.
    """
    spark = found.sparkSession
    by_rule = _labelled(_found(spark.createDataFrame(examples(), "text string, given double"), ["given"]), F.col("row.given"))
    own = _labelled(found, F.lit(None).cast("double")).dropDuplicates(["same", "kind", "first", "past"])
    rows = by_rule.union(own).select(F.col("kind").alias("kind_index"), "label", "f.*", (F.pmod(F.xxhash64("kind", "first", "past", "f"), F.lit(5)) == 0).alias("held"), "source")
    table = materialize(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")))
    counts = {r["source"]: r for r in table.groupBy("source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    share = min(1.0, counts[0]["n"] / counts[1]["n"]) if 1 in counts else 1.0
    table = table.withColumn("weight", F.when(F.col("source") == 0, 1.0).otherwise(share) * F.col("n"))
    # mostly a few thousand short rows: one partition spares each of the many small jobs its tasks
    parts = 1 + sum(r["rows"] for r in counts.values()) // PART_ROWS
    wide = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table.where("not held").orderBy(*rows.columns).coalesce(parts))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, labelCol="label", weightCol="weight", maxMemoryInMB=64).fit(wide)
    trees = list(zip(model.treeWeights, (_nested(t._call_java("rootNode")) for t in model.trees), strict=True))
    made = SpanModel(trees, {})
    scored = table.where("held").select("kind_index", "label", "weight", F.round(made.margin(F.struct(*FEATURES)), 3).alias("margin"))
    by: dict[int, list[tuple[float, float, float]]] = {}
    for r in scored.groupBy("kind_index", "margin").agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n")).collect():
        by.setdefault(r["kind_index"], []).append((r["margin"], r["good"], r["n"]))
    thresholds = {}
    for kind, bins in by.items():
        good = total = 0.0
        ordered = sorted(bins, reverse=True)
        for (margin, g, k), below in zip(ordered, [*(b[0] for b in ordered[1:]), 0.0], strict=True):
            good, total = good + g, total + k
            if good >= PRECISION * total:
                thresholds[kind] = max((margin + below) / 2, 0.0)
    return SpanModel(trees, thresholds)


def personal_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns), ``base`` and ``spans``: arrays of (kind index into ``KINDS``, first, past), sorted.

    Base spans always stay; an accepted candidate is added unless it overlaps a base span. A null text is empty and has no spans; repeated rows get
    equal results; an empty table gives an empty result. Very long texts are scanned whole: offsets are summed in blocks and spans compared within
    drawers of positions, so the work grows nearly in line with the matches. Column expressions and library trees only. Texts are never shuffled;
    they are scanned once: what is found is stored with the kept columns, the trees are fitted on all of it and then judge it.
    """
    found = materialize(_found(docs, keep))
    model = fit(found)
    extra = F.filter("cands", lambda c: model.accepts(c) & ~overlapping(c, F.col("drawers")))
    extra = F.array_distinct(F.transform(extra, lambda c: F.struct(c["kind"], c["first"], c["past"])))
    return found.select("row", "base", F.sort_array(F.concat("base", extra)).alias("spans"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, the number of base matches of each kind, the digest of the base spans, and all spans as text."""
    df = personal_spans(docs, ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return df.select("row.doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])),
                     F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, and ``n_chars`` (if there) counted anew.

    Overlapping spans are replaced once, by the kind of the one that starts first. A null text stays null; texts without spans stay
    as they are. All columns are returned under their names.
    """
    kept = docs.columns
    df = personal_spans(docs, kept)
    text = F.col("row.text")
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["first"], s["past"], s["kind"])))
    names = F.array(*(F.lit(f"[{k.split('_')[0].upper()}]") for k in KINDS))

    def step(acc, s):
        fresh = s["first"] >= acc["past"]
        piece = F.concat(F.substring(text, acc["past"] + 1, s["first"] - acc["past"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"), F.greatest(acc["past"], s["past"]).alias("past"))

    done = F.aggregate(ordered, F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("past")), step,
                       lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["past"] + 1, F.length(text))))
    clean = df.select("row", F.when(F.size("spans") == 0, text).otherwise(done).alias("clean"))
    return clean.select(*(F.col("clean").alias(c) if c == "text" else
                          F.when(F.col("clean").isNotNull(), F.length("clean").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]).alias(c) if c == "n_chars" else
                          F.col("row")[c].alias(c) for c in kept))
