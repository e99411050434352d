"""Personal data by candidate gradient boosting, made of DataFrame and SQL functions only.

Base rules find e-mail and IP addresses, payment cards and phone numbers. Beside them, high-recall generators propose
overlapping spans of the same kinds in looser forms (spelled-out signs, other separators, no country code). Boosted
trees judge a candidate by its format and by the words around it. They learn from the corpus: true are the values that the base
rules confirm, both as they stand and rewritten into looser spellings in the same place; false are candidates that no rule
supports (a card without its check digit, an address part above 255, a date or a short number) and values spoilt that way. Looser forms that stand in the
corpus are neither: they are what is judged. Features leave out the mark that a base rule asks for. All of them are learnt from, as counts of what looks the same. Two halves of the values train one
model each; a threshold for each kind is set where the other half's model keeps a fixed precision, and both models' mean is
taken. The trees become SQL expressions, so that scoring is part of one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

KINDS = ["email", "ip", "card", "phone"]

#: Base patterns; possessive forms match the same strings in linear time. A match cannot begin inside a run that a longer one would begin.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Generators of looser forms of each kind; the counts in them are those of the forms (a name of 64 characters, a domain of five labels).
LOOSE = {
    "email": r"(?i)\b[a-z0-9._%+-]{1,64}\s?(?:@|\(at\)|\[at\]|\{at\})\s?[a-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?[a-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\))\s?[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00|\(|\+)?\(?[0-9]{1,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9])",
}
#: Code points of context on each side of a candidate.
CONTEXT = 32
CUES = {
    "email": r"(?i)e-?mail|contact|write|mailto|courriel|correo",
    "ip": r"(?i)\bip\b|address|host|server|adresse",
    "card": r"(?i)card|visa|account|payment|carte|tarjeta|konto|karte",
    "phone": r"(?i)phone|call|\btel\b|mobile|fax|t[eé]l[eé]f|anruf",
}
FEATURES = ["kind_no", "chars", "digits", "letters", "blanks", "dots", "dashes", "parens", "groups", "longest", "shortest", "ats", "spelled", "checks", "cue", "left_digit", "right_digit", "left_word", "right_word"]

#: Trees, their depth, and the limits that a feature can be split at: more than any feature has, and so many that all rows are asked for them (Spark samples rows beyond the square of this).
TREES, DEPTH, BINS = 12, 4, 512
#: Share of true ones that candidates above a kind's threshold have, by the model that did not learn from them.
PRECISION = 0.98
#: Elements whose running sums are made in one fold.
_RUN = 256
#: Characters of a block of text.
_BLOCK = 4096
#: Behind any text.
_FAR = (1 << 31) - 1


def _luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn test?"""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + F.floor(2 * c.cast("int") / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x.cast("int"), F.lit(0))) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _is_ip(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 3).cast("int"), F.lit(999)) <= 255))


def _passes(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _is_ip(text)
    n = F.length(_digits(text))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(text))).otherwise(False)
    return (n >= 9) & (n <= 15)


def _passing(kind: str):
    return lambda span: _passes(kind, span["value"])


def _located(text: Column, pattern: str, where: Column) -> tuple[Column, Column]:
    """All matches, and the text between them; both NULL where no match is possible."""
    return F.when(where, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.when(where, F.split(text, pattern, -1))


def _scan(values: Column, take: Callable[[Column, Column], Column], first: int, kind: str = "int") -> Column:
    """What `take` makes of `first` and all values up to each, in folds over _RUN of them, since a fold copies what it has at each step."""
    start = F.lit(first).cast(kind)
    none = F.array().cast(f"array<{kind}>")
    add = lambda at: F.struct(at.alias("at"), none.alias("out"))
    step = lambda a, v: F.struct(take(a["at"], v).alias("at"), F.concat(a["out"], F.array(take(a["at"], v))).alias("out"))
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / _RUN).cast("int")), lambda k: F.slice(values, k * _RUN + 1, _RUN))
    totals = F.transform(runs, lambda r: F.aggregate(r, start, take))
    upto = F.aggregate(totals, add(start), step, lambda a: a["out"])
    before = F.slice(F.concat(F.array(start), upto), F.lit(1), F.size(totals))
    return F.flatten(F.zip_with(runs, before, lambda r, at: F.aggregate(r, add(at), step, lambda a: a["out"])))


def _larger(a: Column, v: Column) -> Column:
    return F.greatest(a, v)


def _running(values: Column) -> Column:
    return _scan(values, lambda a, v: a + v, 0)


def _blocks(text: Column) -> Column:
    """The text in blocks of _BLOCK characters, found in one walk; a place in a text takes a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}+"), F.lit(0))


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end, which may lie behind the text's end."""
    first = F.floor(start / _BLOCK).cast("int")
    some = F.slice(blocks, first + 1, F.floor((end - 1) / _BLOCK).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), start - first * _BLOCK + 1, end - start)


def _span(end: Column, match: Column) -> Column:
    """A match that ends at a place in code points."""
    return F.struct((end - F.length(match)).cast("int").alias("start"), end.cast("int").alias("end"), match.alias("value"))


def _empty(array: Column, kind: str = "array<struct<start:int,end:int,value:string>>") -> Column:
    return F.coalesce(array, F.array().cast(kind))


def find_base(docs: DataFrame) -> DataFrame:
    """docs and, for each kind, base_<kind>: the base rule's spans in the text (a null text has none), and loose_<kind>: the candidates beside them."""
    text = F.col("_text")
    out = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    some = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": F.contains(text, F.lit("+"))}
    might = {
        "email": text.rlike(r"(?i)@|\(at\)|\[at\]|\{at\}"),
        "ip": text.rlike(r"[0-9]\s?(?:\.|\[\.\]|\(\.\))\s?[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20./_-]{0,2}[0-9]){12}"),
        "phone": text.rlike(r"[0-9]\)?[\x20./-]{1,2}\(?[0-9]{2,4}\)?[\x20./-]{1,2}\(?[0-9]{2}"),
    }
    out = out.withColumns({f"_has_{k}": some[k] for k in KINDS} | {f"_might_{k}": might[k] for k in KINDS})
    found, gaps = {}, {}
    for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True):
        found[f"_m_{kind}"], gaps[f"_g_{kind}"] = _located(text, pattern, F.col(f"_has_{kind}"))
        found[f"_lm_{kind}"], gaps[f"_lg_{kind}"] = _located(text, LOOSE[kind], F.col(f"_might_{kind}"))
    out = out.withColumns(found)
    out = out.withColumns({name: F.when(F.size(F.col("_m_" + name[3:] if name.startswith("_g_") else "_lm_" + name[4:])) > 0, gap) for name, gap in gaps.items()})
    lists = [(f"{name}_{k}", f"_m_{k}" if name == "base" else f"_lm_{k}", f"_g_{k}" if name == "base" else f"_lg_{k}") for name in ("base", "loose") for k in KINDS]
    out = out.withColumns({f"_n_{name}": F.zip_with(m, F.slice(g, 1, F.size(m)), lambda m, g: F.length(g) + F.length(m)) for name, m, g in lists})
    out = out.withColumns({f"_e_{name}": F.when(F.size(m) > 0, _running(F.col(f"_n_{name}"))) for name, m, _ in lists})
    spans = {name: F.zip_with(f"_e_{name}", m, _span) for name, m, _ in lists}
    out = out.withColumns({name: _empty(F.filter(c, _passing(name[5:])) if name.startswith("base_") else c) for name, c in spans.items()})
    return out.select(*docs.columns, "_text", *spans)


def _around(span: Column, blocks: Column) -> Column:
    """A candidate with its context: (start, end, value, left, right)."""
    left = _piece(blocks, F.greatest(span["start"] - CONTEXT, F.lit(0)), span["start"])
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), span["value"].alias("value"), left.alias("left"), _piece(blocks, span["end"], span["end"] + CONTEXT).alias("right"))


def _features(kind: str, v: Column, left: Column, right: Column) -> list[Column]:
    """FEATURES of a value's format and context. Neither the leading plus of a phone number nor the sign @ itself counts."""
    runs = F.regexp_extract_all(v, F.lit("[0-9]++"), F.lit(0))
    lengths = F.transform(runs, lambda r: F.length(r))
    count = lambda pattern: F.size(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)))
    digits = F.length(_digits(v))
    values = {
        "kind_no": F.lit(KINDS.index(kind)),
        "chars": F.length(F.regexp_replace(v, r"^\+", "")),
        "digits": digits,
        "letters": count("[A-Za-z]"),
        "blanks": count(r"\s"),
        "dots": count(r"\."),
        "dashes": count("-"),
        "parens": count("[()]"),
        "groups": F.size(runs),
        "longest": F.coalesce(F.array_max(lengths), F.lit(0)),
        "shortest": F.coalesce(F.array_min(lengths), F.lit(0)),
        "ats": F.when(v.rlike(r"(?i)@|\(at\)|\[at\]|\{at\}"), 1).otherwise(0),
        "spelled": F.when(v.rlike(r"(?i)\((?:at|dot|\.)\)|\[(?:at|dot|\.)\]|\{(?:at|dot)\}"), 1).otherwise(0),
        "checks": F.when(_unsupported(kind, v), 0).otherwise(1),
        "cue": F.when(left.rlike(CUES[kind]), 1).otherwise(0),
        "left_digit": F.when(left.rlike(r"[0-9]\S?$"), 1).otherwise(0),
        "right_digit": F.when(right.rlike(r"^\S?[0-9]"), 1).otherwise(0),
        "left_word": F.when(left.rlike(r"\S$"), 1).otherwise(0),
        "right_word": F.when(right.rlike(r"^\w"), 1).otherwise(0),
    }
    return [values[f].cast("double").alias(f) for f in FEATURES]


def _featured(spans: Column, kind: str, blocks: Column) -> Column:
    """Candidates (start, end) with FEATURES."""
    return F.transform(F.transform(spans, lambda s: _around(s, blocks)), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), *_features(kind, c["value"], c["left"], c["right"])))


def _unsupported(kind: str, v: Column) -> Column:
    """Is a candidate one that no rule for its kind supports, however loosely it is spelled?"""
    digits = _digits(v)
    if kind == "email":
        return ~v.rlike(r"(?i)[a-z]{2,}$")  # no top-level domain
    if kind == "ip":
        return F.exists(F.regexp_extract_all(v, F.lit("[0-9]++"), F.lit(0)), lambda p: p.cast("int") > 255)
    if kind == "card":
        return ~_luhn(digits)
    date = v.rlike(r"^(?:19|20)[0-9]{2}[./-](?:0?[1-9]|1[0-2])[./-][0-3]?[0-9](?![0-9])|^[0-3]?[0-9][./-](?:0?[1-9]|1[0-2])[./-](?:19|20)[0-9]{2}(?![0-9])")
    return (F.length(digits) < 9) | (F.length(digits) > 15) | date


def _looser(kind: str, v: Column) -> Column:
    """Other spellings of a confirmed value."""
    if kind == "email":
        name, domain = F.split_part(v, F.lit("@"), F.lit(1)), F.split_part(v, F.lit("@"), F.lit(2))
        dots = F.replace(domain, F.lit("."), F.lit("[dot]"))
        return F.array(F.concat(name, F.lit("(at)"), domain), F.concat(name, F.lit(" [at] "), domain), F.concat(name, F.lit("[at]"), dots), F.concat(name, F.lit(" @ "), domain))
    if kind == "ip":
        return F.array(*[F.replace(v, F.lit("."), F.lit(sign)) for sign in ("[.]", "(.)", " . ", " .")])
    if kind == "card":
        return F.array(*[F.regexp_replace(_digits(v), "([0-9]{4})(?=[0-9])", f"$1{sign}") for sign in (".", "/", "_", "  ")])
    bare = F.regexp_replace(v, r"^\+", "")
    return F.array(F.concat(F.lit("00"), bare), bare, F.regexp_replace(bare, r"[\x20-]+", "."), F.regexp_replace(bare, r"^[0-9]{1,3}[\x20.-]+", ""))


def _spoilt(kind: str, v: Column) -> Column:
    """Values that look like v and that no rule supports."""
    if kind == "email":
        return F.array(F.concat(F.split_part(v, F.lit("@"), F.lit(1)), F.lit("(at)12.5")))
    if kind == "ip":
        return F.array(F.regexp_replace(v, "[0-9]+$", "999"))
    if kind == "card":
        last = F.length(_digits(v))
        wrong = F.concat(F.substring(_digits(v), F.lit(1), last - 1), ((F.substring(_digits(v), last, F.lit(1)).cast("int") + 1) % 10).cast("string"))
        return F.array(wrong, F.regexp_replace(wrong, "([0-9]{4})(?=[0-9])", "$1-"))
    tail = F.substring(_digits(v), F.lit(1), F.lit(2))
    return F.array(F.concat(F.lit("2024-03-"), tail, F.lit(" 10 30")), F.concat(F.lit("20"), tail, F.lit(".10.11")))


def _field(name: str, what: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    """What is made of a field of a struct and the struct."""
    return lambda z: what(z[name], z)


def _swept(docs: DataFrame, pairs: dict[str, tuple[Column, list[Column]]]) -> DataFrame:
    """For each name with its spans and lists of others: swept_<name>, the spans (start, end, value) in order with `apart` (no other overlaps) and `first` (the first list has the same).

    All are sorted once; what reaches farthest from before a span and what begins next after it tell whether any overlaps. NULL where there are no spans.
    """
    span = lambda role, value: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(role).alias("role"), value(s).alias("value"))
    both = {}
    for name, (mine, others) in pairs.items():
        rest = [F.transform(o, span(min(i, 1), lambda s: F.lit(""))) for i, o in enumerate(others)]
        both[f"_both_{name}"] = F.when(F.size(mine) > 0, F.array_sort(F.concat(*rest, F.transform(mine, span(2, lambda s: s["value"])))))
    out = docs.withColumns(both)
    other = lambda name, value, none: F.transform(f"_both_{name}", lambda s: F.when(s["role"] < 2, value(s)).otherwise(F.lit(none)))
    place = lambda s: s["start"].cast("bigint") * (1 << 32) + s["end"]
    # columns of their own, since a scan looks into its values for each run
    values, scans = {}, {}
    for name in pairs:
        values[f"_ends_{name}"] = other(name, lambda s: s["end"], 0)
        values[f"_starts_{name}"] = F.reverse(other(name, lambda s: s["start"], _FAR))
        values[f"_places_{name}"] = F.transform(f"_both_{name}", lambda s: F.when(s["role"] == 0, place(s)).otherwise(F.lit(-1).cast("bigint")))
        some = F.col(f"_both_{name}").isNotNull()
        scans[f"_reach_{name}"] = F.when(some, _scan(F.col(f"_ends_{name}"), _larger, 0))
        scans[f"_next_{name}"] = F.when(some, F.reverse(_scan(F.col(f"_starts_{name}"), lambda a, v: F.least(a, v), _FAR)))
        scans[f"_same_{name}"] = F.when(some, _scan(F.col(f"_places_{name}"), _larger, -1, "bigint"))
    out = out.withColumns(values).withColumns(scans)
    swept = {}
    for name in pairs:
        b, *found = (f"_{c}_{name}" for c in ("both", "reach", "next", "same"))
        spans = F.filter(F.arrays_zip(b, *found), _field(b, lambda s, _: s["role"] == 2))
        swept[f"swept_{name}"] = F.transform(spans, _field(b, lambda s, z, f=found: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), ((z[f[0]] <= s["start"]) & (z[f[1]] >= s["end"])).alias("apart"), (z[f[2]] == place(s)).alias("first"))))
    return out.withColumns(swept).drop(*both, *values, *scans)


def _candidates(docs: DataFrame) -> DataFrame:
    """find_base with _blocks of texts that have matches, and swept_<kind>: candidates held against the base spans of all kinds, those of their own first."""
    out = find_base(docs)
    some = reduce(lambda a, b: a | b, [F.size(f"{name}_{k}") > 0 for name in ("base", "loose") for k in KINDS])
    pairs = {k: (F.col(f"loose_{k}"), [F.col(f"base_{o}") for o in (k, *[o for o in KINDS if o != k])]) for k in KINDS}
    return _swept(out.withColumn("_blocks", F.when(some, _blocks(F.col("_text")))), pairs)


class Model:
    """Trees (with weights) as SQL expressions, and a threshold for each kind."""

    def __init__(self, trees: list[tuple[float, object]], thresholds: dict[str, float]) -> None:
        self.trees, self.thresholds = trees, thresholds

    def chooses(self, kind: str):
        return lambda candidate: self.probability(candidate) >= self.thresholds[kind]

    def probability(self, candidate: Column) -> Column:
        if not self.trees:
            return F.lit(0.0)
        total = reduce(lambda a, b: a + b, [F.lit(w) * _tree(t, candidate) for w, t in self.trees])
        return 1 / (1 + F.exp(-2 * total))


def _tree(node, candidate: Column) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, limit, low, high = node
    return F.when(candidate[feature] <= limit, _tree(low, candidate)).otherwise(_tree(high, candidate))


def _nodes(node):
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return FEATURES[split.featureIndex()], float(split.threshold()), _nodes(node.leftChild()), _nodes(node.rightChild())


def _read(model: GBTClassificationModel) -> list[tuple[float, object]]:
    return [(float(w), _nodes(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees, strict=True)]


def _judged(kind: str):
    """A candidate with its label: true where the base rule found the same, false where no rule supports it, else none."""

    def one(s: Column) -> Column:
        label = F.when(s["first"], 1.0).when(s["apart"] & _unsupported(kind, s["value"]), 0.0)
        return F.struct(F.lit(kind).alias("kind"), label.alias("label"), _around(s, F.col("_blocks")).alias("c"))

    return one


def _forms(kind: str) -> Column:
    """A candidate's value with its label and, if it is true, other spellings of it and spoilt ones that the generator would propose."""
    v = F.col("value")
    form = lambda value, label: F.struct(value.alias("value"), label.alias("label"))
    others = F.concat(F.transform(_looser(kind, v), lambda x: form(x, F.lit(1.0))), F.transform(_spoilt(kind, v), lambda x: form(x, F.lit(0.0))))
    proposed = F.filter(others, lambda x: x["value"].rlike(f"^(?:{LOOSE[kind]})$"))
    return F.concat(F.array(form(v, F.col("label"))), F.when(F.col("label") == 1, proposed).otherwise(F.array().cast("array<struct<value:string,label:double>>")))


def _by_kind(column) -> Column:
    """column(kind) of the kind that the row has."""
    return F.coalesce(*[F.when(F.col("kind") == k, column(k)) for k in KINDS])


def _labelled_counts(docs: DataFrame) -> DataFrame:
    """(label, half, FEATURES, n): how many labelled candidates of all documents have these features, each value once for each label and features; one pass over the documents."""
    found = _candidates(docs.select("text"))
    each = [F.filter(F.transform(F.col(f"swept_{k}"), _judged(k)), lambda c: c["label"].isNotNull()) for k in KINDS]
    none = F.array().cast("array<struct<kind:string,label:double,c:struct<start:int,end:int,value:string,left:string,right:string>>>")
    rows = found.select(F.explode(reduce(F.concat, [F.coalesce(e, none) for e in each])).alias("e")).select("e.kind", "e.label", "e.c.value", "e.c.left", "e.c.right")
    rows = rows.withColumn("order", F.xxhash64("value"))
    formed = rows.select("kind", "order", "left", "right", F.explode(_by_kind(_forms)).alias("f"))
    features = _by_kind(lambda k: F.struct(*_features(k, F.col("f.value"), F.col("left"), F.col("right"))))
    labelled = formed.select("order", F.col("f.label").alias("label"), features.alias("x")).select("order", "label", "x.*")
    # one row for each kind of format first, so that a common value does not outweigh others
    one = labelled.groupBy("order", "label", *FEATURES).agg(F.lit(1).alias("one"))
    half = (F.pmod(F.xxhash64("order", F.lit(9)), F.lit(2)) == 0).alias("half")
    return one.groupBy("label", half, *FEATURES).agg(F.count("*").cast("double").alias("n"))


def fit(docs: DataFrame) -> Model:
    """Trees and thresholds from all labelled candidates of the documents.

    Without both true and false candidates in both halves of them the model adds nothing, and so it does for a kind without true ones.
    """
    counted = durable(_labelled_counts(docs))
    if counted.groupBy("half", "label").count().count() < 4:
        return Model([], {k: 1.1 for k in KINDS})
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(counted)
    halves = {half: _read(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, stepSize=0.3, seed=11, weightCol="n").fit(vectors.where(F.col("half") == half).select("features", "label", "n"))) for half in (True, False)}
    row = F.struct(*FEATURES)
    judged = counted.withColumn("p", F.when(F.col("half"), Model(halves[False], {}).probability(row)).otherwise(Model(halves[True], {}).probability(row)))
    # the least probability down to which the share of true ones stays at PRECISION; ties count together
    each = judged.groupBy("kind_no", "p").agg(F.sum(F.col("label") * F.col("n")).alias("true"), F.sum("n").alias("n"))
    upto = Window.partitionBy("kind_no").orderBy(F.desc("p"))
    good = each.select("kind_no", "p", "true", F.sum("true").over(upto).alias("t"), F.sum("n").over(upto).alias("all")).where((F.col("t") >= PRECISION * F.col("all")) & (F.col("true") > 0))
    least = {KINDS[int(r["kind_no"])]: r["p"] for r in good.groupBy("kind_no").agg(F.min("p").alias("p")).collect()}
    trees = [(w / 2, t) for half in halves.values() for w, t in half]
    return Model(trees, {k: max(least[k], 0.5) if k in least else 1.1 for k in KINDS})


def find(docs: DataFrame, model: Model) -> DataFrame:
    """docs, _text (the text, empty for null), _blocks, base_<kind> and all_<kind>: spans with those that the model adds, in order. Time is that of sorting a text's matches."""
    out = _candidates(docs)
    span = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    new = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("value"))
    added = {}
    for kind in KINDS:
        chosen = F.filter(_featured(F.filter(f"swept_{kind}", lambda s: s["apart"]), kind, F.col("_blocks")), model.chooses(kind))
        added[f"_new_{kind}"] = _empty(F.transform(chosen, new))
    out = out.withColumns(added)
    # kinds before have precedence where candidates overlap
    out = _swept(out.drop(*[f"swept_{k}" for k in KINDS]), {k: (F.col(f"_new_{k}"), [F.col(f"_new_{o}") for o in KINDS[:i]]) for i, k in enumerate(KINDS) if i})
    mine = {k: _empty(F.filter(f"swept_{k}", lambda s: s["apart"]), "array<struct<start:int,end:int,value:string,apart:boolean,first:boolean>>") if i else F.col(f"_new_{k}") for i, k in enumerate(KINDS)}
    out = out.withColumns({f"all_{k}": F.array_sort(F.concat(F.transform(F.col(f"base_{k}"), span), F.transform(mine[k], span))) for k in KINDS})
    return out.drop(*added, *[f"{name}_{k}" for name in ("loose", "swept") for k in KINDS])


def _written(columns: str) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.concat_ws(",", *[F.transform(F.col(f"{columns}_{k}"), _named(k)) for k in KINDS])


def _named(kind: str):
    return lambda span: F.concat_ws(":", F.lit(kind), span["start"].cast("string"), span["end"].cast("string"))


def personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, counts of the base rules' finds, their digest, and all spans of each document.

    A null or empty text has none: counts 0, the digest of an empty string, spans empty. Null and repeated doc_ids are
    ordinary rows; other columns are left out.
    """
    narrow = docs.select("doc_id", "text")
    found = find(narrow, model or fit(narrow))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("all").alias("spans"))


def _labelled(kind: str):
    return lambda span: F.struct(span["start"].alias("start"), span["end"].alias("end"), F.lit(kind.upper()).alias("kind"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets, as `[EMAIL]`; overlapping spans are replaced together, named after the first.

    A null text stays null; texts without spans stay as they are; n_chars, if there is such a column, follows the text. Null and repeated doc_ids are
    ordinary rows, other columns stay whatever their names; an empty table gives an empty one.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # other columns can have any name
    found = find(docs.select(row, "text"), model or fit(docs.select("text")))
    named = F.array_sort(F.concat(*[F.transform(F.col(f"all_{k}"), _labelled(k)) for k in KINDS]))
    out = found.withColumn("_spans", named).withColumn("_ends", F.transform("_spans", lambda s: s["end"]))
    out = out.withColumn("_reached", F.when(F.size("_spans") > 0, _scan(F.col("_ends"), _larger, 0)))
    before = F.slice(F.concat(F.array(F.lit(0)), F.col("_reached")), F.lit(1), F.size("_spans"))
    blocks = F.col("_blocks")
    parts = F.zip_with("_spans", before, lambda s, at: F.when(s["start"] >= at, F.concat(_piece(blocks, at, s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit("")))
    whole = F.concat(F.array_join(parts, ""), _piece(blocks, F.element_at("_reached", -1), F.length("_text")))
    out = out.withColumn("text", F.when(F.size("_spans") > 0, whole).otherwise(F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return out.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
