"""Personal data by base rules and boosted candidates, in DataFrame operations only.

Generators propose spans, kind by kind, leftmost and without overlaps within a kind:
the four base kinds (email, ip, card, phone), and with high recall ``secret`` (long
runs of letters and digits with a digit) and ``number`` (digit groups). Spans of
different kinds may overlap. A base span that passes its rule is kept as it is.

The rest are candidates: base spans that fail their rule, secrets and numbers. A
span has features of its format (length, shares of digits, capitals and letters, separators,
hexadecimal or not) and of its context (a quote or a space before
it). Gradient-boosted trees learn from weak labels: base spans that pass or fail
their rules, and secrets and numbers with or without an assigned name (secrets: or a known prefix) before them. Neither the rules' sums
nor the names and prefixes are features, so the trees can't restate the labels: they learn how
such data look, and find those without a name too. Secrets and numbers have a threshold each, calibrated on
the candidates of all documents that the trees haven't seen (never on base spans that pass, which are kept
anyway): the least at which ``LEAST_PRECISION`` of the candidates above are labelled personal. Candidates at or
above it that overlap no kept base span are added under their own kinds (a failed base span as ``number``).

Positions come from the texts between matches, so no span is searched for twice. The trees
are turned into one SQL expression; a document's spans are found, scored and joined in its own row,
without a shuffle. Learning uses about ``SAMPLE_ROWS`` documents (a documented
bound: rows are taken by a hash of doc_id below a cut-off); every text is scanned whole.

Patterns don't backtrack over long runs: repetitions are possessive, and a run is entered
only at its start or where the last match ended.

Null and empty texts have no spans. Repeated rows get equal results. If the sample
lacks one of the labels, or no threshold is precise enough, only base spans remain. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from footgrid.llm.common import written

#: The base patterns of the contract, made possessive, and two generators of candidates.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{16,}+",
    "number": r"(?<![0-9])[0-9](?:[\x20./()-]{0,2}+[0-9]){6,}+",
}
BASE = ("email", "ip", "card", "phone")
#: A text without this cannot hold a match.
NEEDS = {"email": "@", "phone": "+", "ip": "."}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
NAMES = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|token|secret|key|auth|phone|tel|mobile|card|account|iban|ssn)[^A-Za-z0-9]{0,4}$"
FEATURES = ("length", "digits", "capitals", "letters", "separators", "hexadecimal", "quoted", "spaced")
SAMPLE_ROWS = 20_000
LEAST_PRECISION = 0.98
SPAN = "struct<start:int,end:int,before:string,match:string>"
CONTEXT = 24
PART = 256


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_of(kind: str, text: str = "text") -> Column:
    """Array of a generator's spans in a text column: start and end (exclusive) in code points, context, match.

    The pieces between matches and the matches are added up in turn. Finished
    spans are kept in parts, so that adding one copies no long array.
    """
    r = _quoted(PATTERNS[kind])
    turns = f"zip_with(split({text}, {r}, -1), regexp_extract_all({text}, {r}, 0), (a, b) -> named_struct('g', length(a), 'before', right(a, {CONTEXT}), 'match', b))"
    span = "named_struct('start', acc.pos + x.g, 'end', acc.pos + x.g + length(x.match), 'before', x.before, 'match', x.match)"
    start = f"named_struct('pos', 0, 'part', CAST(array() AS array<{SPAN}>), 'done', CAST(array() AS array<array<{SPAN}>>))"
    step = f"""(acc, x) -> CASE WHEN x.match IS NULL THEN acc ELSE named_struct(
        'pos', acc.pos + x.g + length(x.match),
        'part', CAST(CASE WHEN size(acc.part) >= {PART} THEN array({span}) ELSE concat(acc.part, array({span})) END AS array<{SPAN}>),
        'done', CAST(CASE WHEN size(acc.part) >= {PART} THEN concat(acc.done, array(acc.part)) ELSE acc.done END AS array<array<{SPAN}>>)) END"""
    found = f"aggregate({turns}, {start}, {step}, acc -> concat(flatten(acc.done), acc.part))"
    needs = f"contains({text}, '{NEEDS[kind]}')" if kind in NEEDS else f"{text} IS NOT NULL"
    return F.expr(f"CASE WHEN {needs} THEN {found} ELSE CAST(array() AS array<{SPAN}>) END")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Whether the digits pass: from the right, every second one counts double, less 9 if over 9."""
    d = F.reverse(_digits(match))
    twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    value = lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int"))
    values = F.transform(F.filter(F.split(d, ""), lambda c: c != ""), value)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """Whether a base kind's match holds by its rule."""
    n = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), _luhn(match)).otherwise(False)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _described(kind: str, s: Column) -> Column:
    """A span with its weak label (null: none) and features."""
    match, before = s["match"], s["before"]
    length = F.length(match)
    share = lambda pattern: F.length(F.regexp_replace(match, pattern, "")) / length
    named, prefixed = before.rlike(NAMES), match.rlike("^(?:AKIA|ASIA|ghp|sk|pk)[A-Z0-9]")
    assigned = before.rlike("[=:][\"' ]{0,2}$")
    if kind in BASE:
        label = F.when(passes(kind, match), 1.0).otherwise(0.0)
    elif kind == "secret":
        label = F.when(named & assigned | prefixed, 1.0).otherwise(0.0)
    else:
        label = F.when(named & assigned, 1.0).otherwise(0.0)
    values = {
        "length": length.cast("double"), "digits": share("[^0-9]"), "capitals": share("[^A-Z]"), "letters": share("[^A-Za-z]"), "separators": share("[A-Za-z0-9]"),
        "hexadecimal": match.rlike("^[0-9a-f]+$").cast("double"), "quoted": before.rlike("[\"'`]$").cast("double"), "spaced": before.rlike("[ \\t\\n]$").cast("double"),
    }
    return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), label.alias("label"), *[values[f].alias(f) for f in FEATURES])


def proposed(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All generators' spans of every document, described, an array column for each kind.

    A table in the shared folder: each text is scanned once."""
    kinds = list(PATTERNS)
    found = docs.select(*keep, *[spans_of(k).alias(f"_{k}") for k in kinds])
    return written(found.select(*keep, *[F.transform(f"_{k}", partial(_described, k)).alias(k) for k in kinds]), "proposed")


class Boosted:
    """Trees as nested conditions, their weights, and the calibrated threshold of each kind (2: none is precise enough)."""

    def __init__(self, trees: list, weights: list[float], thresholds: dict[str, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def score(self, s: Column) -> Column:
        """Likelihood that a described span is personal."""

        def of(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, at, low, high = node
            return F.when(s[FEATURES[feature]] <= F.lit(at), of(low)).otherwise(of(high))

        margin = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            margin = margin + F.lit(weight) * of(tree)
        return 1 / (1 + F.exp(-2 * margin))


def _tree(node):
    """A learnt tree's nodes: a float, or (feature, threshold, low, high)."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def trained(found: DataFrame, n_docs: int, sample_rows: int = SAMPLE_ROWS, rounds: int = 8, depth: int = 3) -> Boosted | None:
    """Boosted trees from the proposed spans of a bounded sample of documents."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    cut = min(1 << 20, -(-sample_rows * (1 << 20) // max(1, n_docs)))
    # Half of the sample is seen by the trees; the spans of all other documents calibrate the threshold.
    seen = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < cut) & (F.xxhash64("doc_id", F.lit(1)) % 2 == 0)
    spans = found.select(seen.alias("seen"), F.explode(F.concat(*PATTERNS)).alias("s")).select("seen", "s.*")
    spans = written(spans, "spans")
    labels = {r["label"] for r in spans.where("seen").select("label").distinct().collect()}  # two values at most
    if len(labels) < 2:
        return None
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(spans.where("seen"))
    model = GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, seed=9, maxMemoryInMB=64).fit(table.select("label", "features"))
    boosted = Boosted([_tree(t._call_java("rootNode")) for t in model.trees], [float(w) for w in model.treeWeights], {"secret": 2.0, "number": 2.0})
    score = boosted.score(F.struct(*[F.col(f).alias(f) for f in FEATURES]))
    candidate = F.col("kind").isin("secret", "number") | (F.col("label") == 0.0)
    kind = F.when(F.col("kind") == "secret", "secret").otherwise("number").alias("kind")
    bins = spans.where(~F.col("seen") & candidate).groupBy(kind, F.floor(score * 50).alias("bin")).agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()  # 51 bins of two kinds
    good, n = dict.fromkeys(boosted.thresholds, 0.0), dict.fromkeys(boosted.thresholds, 0)
    for r in sorted(bins, key=lambda r: -r["bin"]):
        good[r["kind"]] += r["good"]
        n[r["kind"]] += r["n"]
        if r["bin"] >= 25 and good[r["kind"]] >= LEAST_PRECISION * n[r["kind"]]:
            boosted.thresholds[r["kind"]] = r["bin"] / 50
    return boosted


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_spans(found: DataFrame, model: Boosted | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``base`` (kept base spans) and ``added`` (candidates selected by the trees), arrays in order, for each row."""
    short = lambda s, kind=None: F.struct((s["kind"] if kind is None else F.lit(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    held = [F.transform(F.filter(k, lambda s: s["label"] == 1.0), lambda s: short(s)).alias(f"base_{k}") for k in BASE]
    rest = [F.filter(k, lambda s: s["label"] == 0.0) for k in BASE]
    rows = found.select(*keep, *held, F.concat(*rest, "number").alias("numbers"), F.col("secret").alias("secrets"))
    rows = rows.select("*", F.concat(*[F.col(f"base_{k}") for k in BASE]).alias("base"))

    def free(s: Column, *others: str) -> Column:
        apart = lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])
        return ~F.exists(others[0], apart)

    if model is None or min(model.thresholds.values()) > 1:
        none = F.expr("CAST(array() AS array<struct<kind:string,start:int,end:int>>)")
        return rows.select(*keep, *[f"base_{k}" for k in BASE], "base", none.alias("added"))
    # The score comes first: only the few spans that it selects are held against the others.
    chosen = lambda c, kind: F.transform(F.filter(c, lambda s: (model.score(s) >= model.thresholds[kind]) & free(s, "base")), lambda s: short(s, kind))
    rows = rows.select("*", chosen("secrets", "secret").alias("s"), chosen("numbers", "number").alias("n"))
    numbers = F.array_distinct(F.filter("n", lambda s: free(s, "s")))
    return rows.select(*keep, *[f"base_{k}" for k in BASE], "base", F.concat(F.array_sort("s"), F.array_sort(numbers)).alias("added"))


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of the base spans, and all spans, for each document."""
    found = proposed(docs)
    spans = personal_spans(found, trained(found, found.count()))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return spans.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), F.size(F.concat("base", "added")).cast("long").alias("n_spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span of their texts replaced by its kind in angle brackets.

    Overlapping spans are one, named by the first."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # The documents' other columns travel in one, so that none of their names can clash.
    own = docs.select("doc_id", "text", F.struct(F.lit(True).alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("doc"))
    keep = ("doc_id", "text", "doc")
    found = proposed(own, keep)
    spans = personal_spans(found, trained(found, found.count()), keep)
    order = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = spans.withColumn("_order", order)
    # Finished pieces are kept in parts, so that adding one copies no long array.
    piece = "concat(substring(text, acc.pos + 1, s.start - acc.pos), '<', upper(s.kind), '>')"
    step = f"""aggregate(_order, named_struct('pos', 0, 'part', CAST(array() AS array<string>), 'done', CAST(array() AS array<array<string>>)),
        (acc, s) -> CASE WHEN s.start < acc.pos THEN named_struct('pos', greatest(acc.pos, s.end), 'part', acc.part, 'done', acc.done) ELSE named_struct(
            'pos', greatest(acc.pos, s.end),
            'part', CASE WHEN size(acc.part) >= {PART} THEN array({piece}) ELSE concat(acc.part, array({piece})) END,
            'done', CASE WHEN size(acc.part) >= {PART} THEN concat(acc.done, array(acc.part)) ELSE acc.done END) END,
        acc -> concat(array_join(flatten(acc.done), ''), array_join(acc.part, ''), substring(text, acc.pos + 1)))"""
    text = F.when(F.size("_order") > 0, F.expr(step)).otherwise(F.col("text"))
    column = lambda c: text if c == "text" else F.col(c) if c == "doc_id" else F.col("doc").getField(f"c{others.index(c)}")
    return spans.select(*[column(c).alias(c) for c in docs.columns])
