"""Personal data: plain formats, and what boosted trees recognise beside them. DataFrame functions only.

Base formats are regular expressions with a check each. High-recall generators propose more: separators that are spelled
or bracketed, numbers without a plus, numbers that a longer match has swallowed. Trees that were boosted on the
proposals' format and context give each a margin; a threshold a kind, calibrated on documents held out, selects. Base
spans always stay; a proposal that overlaps one adds nothing, and of proposals that overlap in a chain the best stays.

What is learned from. A proposal that overlaps a base span of its kind is a positive, any other one a negative. Base
spans, rewritten in the ways that generators look for, are further positives in their own context; spoilt ones (check
digit off by one, an octet past 255, a list of years) further negatives. All proposals of all documents count: trees see
nothing but small integers, so rows that agree in them are one row with a weight, and boosting works on these
(all of them; more than ``MOST_ROWS`` are dealt over tasks). Each level of a tree is one aggregate over that table; the driver gets a row a leaf.
One document in ``HELD_OUT`` teaches nothing and sets the thresholds.

Where spans lie. A text is split at a pattern and its matches are extracted: running sums of the lengths of both are
the places, in code points. They are summed in chunks, so a text with very many matches takes no quadratic copies.
Patterns are possessive and begin where a run begins, which finds the same matches in linear time and constant stack.

Texts are read once; what is shuffled and kept are places and small integers.

Defined results: null and empty texts hold nothing; repeated rows, also with equal or null ids, have a row each; without
base spans nothing is learned and nothing is added; ties go to the earlier span, then in the order of ``KINDS``; an empty table
gives an empty result; other columns are ignored. A very long text is one row's work, in memory proportional to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import in_fold, read_table, save

KINDS = ("email", "ip", "card", "phone")
HELD_OUT = 5
ROUNDS, DEPTH, RATE, LAMBDA, LEAST_HESSIAN = 6, 3, 0.6, 1.0, 0.5
MOST_ROWS = 1 << 16
PRECISION = 0.95
CHUNK = 128
CONTEXT = 100

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"[\x20@(\[{<](?:(?<=@)\x20?|[aA][tT](?:(?<=\x20..)\x20|(?<=[(\[{<]..)[)\]}>]\x20?))"
_DOT = r"(?:\x20?[(\[{<](?:[dD][oO][tT]|\.)[)\]}>]\x20?|\x20[dD][oO][tT]\x20|\x20?\.\x20?)"
_GAP = r"[\x20./_-]{1,2}"
GENERATORS = {
    # from the sign on: the part before it is taken from what stands there
    "email": rf"{_AT}[{_LABEL}]++(?:{_DOT}[{_LABEL}]++)++",
    "ip": rf"[0-9](?<![0-9.][0-9])[0-9]{{0,2}}(?:(?:{_DOT}|,\x20?)[0-9]{{1,3}}){{3}}(?![0-9]|\.[0-9])",
    "card": rf"(?=[0-9])(?<![0-9])(?:[0-9]{{13,19}}|[0-9]{{4}}{_GAP}[0-9]{{6}}{_GAP}[0-9]{{5}}|[0-9]{{4}}(?:{_GAP}[0-9]{{4}}){{2}}{_GAP}[0-9]{{1,7}})(?![0-9])",
    "phone": r"(?=[+(0-9])(?<![0-9A-Za-z+])(?:(?:\+|00)?[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z])",
}
#: What a text has to hold at least, quicker to see than any match.
_DIGIT = "[0-9]"
#: The local part of an address before its sign, at most as long as the standard for addresses has it.
_BEFORE_AT = rf"[{_LOCAL}]{{1,64}}\x20?$"
#: Words before a span that tell its kind.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|write|contact|reach)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|iban)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|mobile|cell|call|fax|whatsapp)\b",
}
FEATURES = 10
_BASE, _FOUND, _REWRITTEN, _SPOILT = range(4)


def running(lengths: Column, first: Column) -> Column:
    """Running sums of an array that is not empty, from ``first`` on: chunk by chunk, so that no long array is copied an
    element at a time."""
    add = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
    chunks = F.transform(F.sequence(F.lit(0), F.expr("int((size(lengths) - 1) div %d)" % CHUNK)), lambda k: F.slice(lengths, k * CHUNK + 1, CHUNK))
    starts = F.aggregate(chunks, F.array(first), lambda s, c: add(s, F.aggregate(c, F.lit(0), lambda x, y: x + y)))
    return F.flatten(
        F.zip_with(chunks, F.slice(starts, 1, F.size(chunks)), lambda c, s: F.slice(F.aggregate(c, F.array(s), add), 2, CHUNK))
    )


def worth_a_look(kind: int, source: int) -> Column:
    text = F.col("text")
    if kind == 0:
        return text.contains("@") if source == _BASE else F.lit(True)
    return text.contains("+") & F.col("digit") if kind == 3 and source == _BASE else F.col("digit")


def matches(docs: DataFrame, pattern: str, name: str, where: Column) -> DataFrame:
    """``docs`` with a column ``name``: array of (start, end, hit, before, after) of the pattern's matches in ``text``,
    null where there is none. ``where`` is true for every text that has one."""
    hits, gaps = f"{name}_hits", f"{name}_gaps"
    docs = docs.withColumn(hits, F.when(where, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    docs = docs.withColumn(gaps, F.when(F.size(hits) > 0, F.split("text", pattern, -1)))
    lengths = F.zip_with(F.slice(gaps, 1, F.size(hits)), F.col(hits), lambda g, h: F.length(g) + F.length(h))
    docs = docs.withColumn("lengths", lengths).withColumn("ends", F.when(F.size(hits) > 0, running(F.col("lengths"), F.lit(0))))
    places = F.transform(
        F.arrays_zip(F.col(hits).alias("hit"), F.col("ends").alias("end"), F.slice(gaps, 1, F.size(hits)).alias("gap"), F.slice(gaps, 2, F.size(hits)).alias("next")),
        lambda x: F.struct(
            (x["end"] - F.length(x["hit"])).alias("start"),
            x["end"].alias("end"),
            x["hit"].alias("hit"),
            F.right(x["gap"], F.lit(CONTEXT)).alias("before"),
            F.left(x["next"], F.lit(2)).alias("after"),
        ),
    )
    return docs.withColumn(name, F.when(F.size(hits) > 0, places)).drop(hits, gaps, "lengths", "ends")


def _luhn(digits: str) -> str:
    places = [f"(ascii(substring(lpad({digits}, 20, '0'), {i}, 1)) - 48)" for i in range(1, 21)]
    return f"({' + '.join(f'2 * {x} - if({x} > 4, 9, 0)' if i % 2 == 0 else x for i, x in enumerate(places))}) % 10 = 0"


def luhn(digits: str) -> Column:
    """Whether at most 20 digits, in a column of this name, pass the check of payment cards."""
    return F.expr(_luhn(digits))


def octets_fit(text: Column) -> Column:
    """Whether all runs of digits are at most 255."""
    return ~F.regexp_replace(text, "(?<![0-9])0++(?=[0-9])", "").rlike("[0-9]{4}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9]")


def passes(kind: Column, hit: Column) -> Column:
    """Whether a match of a base pattern holds; ``digits`` and ``luhn`` are columns."""
    n = F.length("digits")
    return (
        F.when(kind == 0, True)
        .when(kind == 1, octets_fit(hit))
        .when(kind == 2, n.between(12, 19) & F.col("luhn"))
        .otherwise(n.between(9, 15))
    )


def features(kind: Column, hit: Column, before: Column, after: Column) -> list[Column]:
    """Small integers that describe a proposal, with ``digits`` and ``luhn`` as columns. None of them tells whether a base
    pattern matches just here."""
    digits = F.col("digits")
    n, groups = F.length(digits), F.size(F.split(hit, "[^0-9]+"))
    tail = F.regexp_extract(F.right(hit, F.lit(70)), r"([A-Za-z0-9-]+)$", 1)  # no longer, as runs that end elsewhere are tried from each place
    number = kind > 0
    kinds_of_gap = sum((hit.rlike(p).cast("int") for p in (r"[0-9]\)?\x20[0-9(]", r"[0-9]\)?-[0-9(]", r"[0-9]\)?\.[0-9(]", r"[0-9]\)?[/_,][0-9(]")), F.lit(0))
    side = lambda c: F.when(c == "", 0).when(c.rlike(r"[\x20\n\t]"), 1).when(c.rlike("[0-9A-Za-z]"), 2).otherwise(3)
    cue = F.lit(0)
    for k, name in enumerate(KINDS):
        cue = F.when((kind == k) & before.rlike(CUES[name]), 1).otherwise(cue)
    return [
        F.when(number, F.least(n, F.lit(20))).otherwise(F.least(F.instr(hit, "@"), F.lit(1))),
        F.when(kind == 2, F.col("luhn").cast("int")).when(kind == 1, octets_fit(hit).cast("int")).otherwise(0),
        F.when(hit.rlike(r"(?i)[(\[{<](?:at|dot|\.)[)\]}>]"), 3).when(hit.rlike(r"(?i)\x20(?:at|dot)\x20"), 2).otherwise(F.lit(0)),
        F.when(number, kinds_of_gap).otherwise(F.when(hit.rlike(r"\x20\.|\.\x20|\x20@|@\x20"), 1).otherwise(0)),
        F.when(hit.rlike(r"\x20dot\x20|[(\[{<](?:dot|\.)"), 1).when(hit.rlike(r"\.\x20"), 2).when(hit.rlike(r","), 3).otherwise(0),
        F.when(number, F.least(groups, F.lit(8))).otherwise(
            F.when(tail.rlike("^[a-z]{2,6}$"), 2).when(tail.rlike("^[A-Za-z]{2,}$"), 1).otherwise(0)
        ),
        F.when(kind == 3, F.when(hit.rlike(r"^\+"), 2).when(hit.rlike("^00"), 1).when(hit.rlike(r"^[0-9]{0,3}\x20?\("), 3).otherwise(0))
        .when(kind == 2, F.when(digits.rlike("^[3-6]"), 1).otherwise(0))
        .otherwise(hit.rlike("^[^@\\x20]*[0-9._]").cast("int")),
        F.when(number, F.when(hit.rlike(r"(?<![0-9])[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}$"), 2).when(hit.rlike(r"^[0-9]{4}([\x20./_-]{0,2})[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), 1).otherwise(0)).otherwise(0),
        cue,
        side(F.right(before, F.lit(1))) * 4 + side(F.left(after, F.lit(1))),
    ]


def variants(kind: Column, hit: Column, digits: Column) -> Column:
    """What a base span becomes for training: (source, hit), the last of them spoilt. Numbers without what a variant
    needs give a variant equal to the span."""
    say = lambda source, h: F.struct(F.lit(source).alias("source"), h.alias("hit"))
    domain = lambda dot: F.concat(
        F.substring_index(hit, "@", 1), F.lit("\0"), F.regexp_replace(F.substring_index(hit, "@", -1), r"\.", dot)
    )
    email = [F.replace(domain(d), F.lit("\0"), F.lit(a)) for a, d in ((" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("(at)", "."), (" @ ", "."))]
    ip = [F.regexp_replace(hit, r"\.", x) for x in ("[.]", "(.)", " dot ", "[dot]")]
    fours = F.regexp_replace(digits, r"([0-9]{4})(?=[0-9])", "$1\0")
    card = [F.replace(fours, F.lit("\0"), F.lit(x)) for x in (".", "/", "  ", " ")]
    last = F.length(digits) - 9
    home = [digits.substr(F.greatest(last, F.lit(1)), F.lit(3)), digits.substr(F.greatest(last + 3, F.lit(1)), F.lit(3)), digits.substr(F.greatest(last + 6, F.lit(1)), F.lit(4))]
    phone = [F.regexp_replace(hit, r"^\+", ""), F.regexp_replace(hit, r"^\+", "00"), F.concat_ws("-", *home), F.concat_ws(".", *home), F.concat(F.lit("("), home[0], F.lit(") "), home[1], F.lit("-"), home[2])]
    spoilt = [
        F.concat(F.lit("it at "), F.substring_index(F.substring_index(hit, "@", -1), ".", 1), F.lit(". The")),
        F.concat(F.lit("9"), F.lpad(F.substring_index(hit, ".", 1), 2, "9"), F.lit("."), F.substring_index(hit, ".", -3)),
        F.concat(F.left(digits, F.greatest(F.length(digits) - 1, F.lit(0))), F.translate(F.right(digits, F.lit(1)), "0123456789", "1234567890")),
        F.concat(F.lit("20"), F.substring(digits, 2, 2), F.lit(" 20"), F.substring(digits, 4, 2), F.lit(" 20"), F.substring(digits, 6, 2)),
    ]
    every = [F.array(*(say(_REWRITTEN, x) for x in told), say(_SPOILT, bad)) for told, bad in zip((email, ip, card, phone), spoilt, strict=True)]
    return F.when(kind == 0, every[0]).when(kind == 1, every[1]).when(kind == 2, every[2]).otherwise(every[3])


_TAGGED = "array<struct<kind:int,source:int,x:struct<start:int,end:int,hit:string,before:string,after:string>>>"


def _tagged(found: str, kind: int, source: int) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(source).alias("source"), x.alias("x")))


def _numbered(told: DataFrame) -> DataFrame:
    told = told.withColumn("digits", F.regexp_replace("hit", "[^0-9]+", ""))
    return told.withColumn("luhn", F.when(F.length("digits") <= 20, luhn("digits")).otherwise(False))


def candidates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, held_out, kind, source, start, end, f0, f1, ...), saved: valid base spans, proposals and what base
    spans were rewritten to. A document with none has one row without a kind."""
    told = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    told, lists = told.withColumn("digit", F.col("text").rlike(_DIGIT)), []
    for k, name in enumerate(KINDS):
        for source, pattern in ((_BASE, BASE[name]), (_FOUND, GENERATORS[name])):
            told = matches(told, pattern, found := f"{name}_{source}", worth_a_look(k, source))
            lists.append(F.coalesce(_tagged(found, k, source), F.array().cast(_TAGGED)))
    told = told.select("row", "doc_id", in_fold(F.col("doc_id"), HELD_OUT).alias("held_out"), F.explode_outer(F.concat(*lists)).alias("s"))
    told = told.select("row", "doc_id", "held_out", "s.kind", "s.source", "s.x.*")
    signed = (F.col("kind") == 0) & (F.col("source") == _FOUND)
    told = told.withColumn("local", F.when(signed, F.regexp_extract("before", _BEFORE_AT, 0)).otherwise(""))
    told = told.withColumn("start", F.col("start") - F.length("local")).withColumn("hit", F.concat("local", "hit"))
    told = told.withColumn("before", F.expr("left(before, length(before) - length(local))"))
    told = _numbered(told)
    valid = F.col("kind").isNull() | ((F.col("source") == _FOUND) & ~(signed & (F.col("local") == ""))) | ((F.col("source") == _BASE) & passes(F.col("kind"), F.col("hit")))
    # what fails is no span, but its document stays: one row without a kind for each
    told = told.withColumn("kind", F.when(valid, F.col("kind")))
    itself = F.struct("source", "hit")
    forms = F.when((F.col("source") == _BASE) & F.col("kind").isNotNull(), F.concat(F.array(itself), variants(F.col("kind"), F.col("hit"), F.col("digits")))).otherwise(F.array(itself))
    told = told.withColumn("form", F.explode(forms)).withColumn("source", F.col("form.source")).withColumn("hit", F.col("form.hit"))
    told = _numbered(told)
    f = features(F.col("kind"), F.col("hit"), F.col("before"), F.col("after"))
    return save(
        told.select("row", "doc_id", "held_out", "kind", "source", "start", "end", *(x.cast("int").alias(f"f{k}") for k, x in enumerate(f))),
        "personal-candidates",
    )


def near_base(spans: DataFrame) -> DataFrame:
    """``spans`` with ``touches`` (overlaps a base span of any kind) and ``same`` (of its own kind)."""
    over = lambda keys, *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    base, out = F.col("kind").isNotNull() & (F.col("source") == _BASE), spans
    for name, keys in (("touches", ["row"]), ("same", ["row", "kind"])):
        up, down = over(keys, "start", "source", "kind"), over(keys, F.desc("start"), F.desc("source"), "kind")
        out = out.withColumn("before_end", F.max(F.when(base, F.col("end"))).over(up))
        # a base span at the same start is met on the way up
        out = out.withColumn("after_start", F.min(F.when(base, F.col("start"))).over(down))
        out = out.withColumn(name, F.coalesce(F.col("before_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("after_start") < F.col("end"), F.lit(False)))
    return out.drop("before_end", "after_start")


def lessons(spans: DataFrame) -> DataFrame:
    """(kind, f0, ..., y, held_out, w), saved: all that there is to learn from, equal rows as a weight. Few rows are one
    task's, so that sums run in one order."""
    f = [f"f{k}" for k in range(FEATURES)]
    y = F.when(F.col("source") == _REWRITTEN, 1).when(F.col("source") == _SPOILT, 0).otherwise(F.col("same").cast("int"))
    rows = spans.where(F.col("source") != _BASE).select("kind", *f, y.alias("y"), "held_out")
    every = rows.groupBy("kind", *f, "y", "held_out").agg(F.count("*").cast("double").alias("w"))
    table = save(every.orderBy(F.desc("w"), "kind", *f, "y", "held_out"), "personal-lessons")
    return table.coalesce(1) if table.count() <= MOST_ROWS else table


class Trees:
    """A margin a kind: sums of small trees, as SQL. ``thresholds`` has no entry for a kind that nothing was learned of."""

    def __init__(self, prior: dict[int, float]):
        self.prior, self.trees, self.thresholds = prior, [], {}

    def margin(self) -> Column:
        return F.expr(" + ".join([_by_kind({k: repr(x) for k, x in self.prior.items()}), *self.trees])).cast("double")


def _by_kind(told: dict[int, str]) -> str:
    return f"CASE kind {' '.join(f'WHEN {k} THEN {x}' for k, x in sorted(told.items()))} END" if told else "NULL"


def _tree(splits: dict, end, kind: int, node: int, left: int) -> str:
    """A kind's tree below ``node``, ``left`` levels deep: SQL of ``end(kind, node)`` at the leaves. Without a split, all
    goes left."""
    if not left:
        return end(kind, node)
    if (kind, node) not in splits:
        return _tree(splits, end, kind, 2 * node, left - 1)
    feature, cut = splits[kind, node]
    low, high = (_tree(splits, end, kind, 2 * node + x, left - 1) for x in (0, 1))
    return f"CASE WHEN f{feature} <= {cut} THEN {low} ELSE {high} END"


_GRADED = [f"f{k}" for k in range(FEATURES)]
_STACKED = "inline(array(" + ", ".join(f"named_struct('feature', {k}, 'bin', f{k})" for k in range(FEATURES)) + "))"


def _best_splits(graded: DataFrame, node: str) -> list:
    """One row a kind and node: the cut of the largest gain (``gain`` 0 where none helps), gradients and hessians up to
    it (gl, hl) and of all (ga, ha)."""
    told = graded.selectExpr("kind", f"{node} AS node", "g", "h", _STACKED)
    told = told.groupBy("kind", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    upto = "OVER (PARTITION BY kind, node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)"
    whole = "OVER (PARTITION BY kind, node, feature)"
    told = told.selectExpr("kind", "node", "feature", "bin", f"sum(g) {upto} AS gl", f"sum(h) {upto} AS hl", f"sum(g) {whole} AS ga", f"sum(h) {whole} AS ha")
    worth = lambda g, h: f"({g}) * ({g}) / ({h} + {LAMBDA})"
    gain = f"{worth('gl', 'hl')} + {worth('ga - gl', 'ha - hl')} - {worth('ga', 'ha')}"
    told = told.selectExpr("*", f"round(CASE WHEN hl >= {LEAST_HESSIAN} AND ha - hl >= {LEAST_HESSIAN} THEN {gain} ELSE 0 END, 6) AS gain")
    told = told.selectExpr("*", "row_number() OVER (PARTITION BY kind, node ORDER BY gain DESC, feature, bin) AS place")
    return told.where("place = 1").collect()


def boost(table: DataFrame) -> Trees:
    """Newton boosting of log loss on the rows that are not held out; a level of all kinds' trees is one aggregate."""
    train = table.where(~F.col("held_out"))
    model = Trees({})
    for r in train.groupBy("kind").agg(F.expr("sum(w * y) AS good"), F.expr("sum(w * (1 - y)) AS bad")).collect():
        if r.good > 0:
            model.prior[r.kind] = 0.5 * math.log((r.good + 1) / (r.bad + 1))
    if not model.prior:
        return model
    train = train.where(F.col("kind").isin(sorted(model.prior))).withColumn("margin", model.margin()).cache()
    for _ in range(ROUNDS):
        graded = train.selectExpr("kind", *_GRADED, "w", "w * (1 / (1 + exp(-margin)) - y) AS g", "w / (1 + exp(-margin)) / (1 + exp(margin)) AS h")
        splits, leaf = {}, {}
        for depth in range(DEPTH):
            node = _by_kind({k: _tree(splits, lambda _, node: str(node), k, 1, depth) for k in model.prior})
            for r in _best_splits(graded, node):
                if r.gain > 0:
                    splits[r.kind, r.node] = r.feature, r.bin
                    leaf[r.kind, 2 * r.node] = -RATE * r.gl / (r.hl + LAMBDA)
                    leaf[r.kind, 2 * r.node + 1] = -RATE * (r.ga - r.gl) / (r.ha - r.hl + LAMBDA)
                else:
                    leaf[r.kind, 2 * r.node] = -RATE * r.ga / (r.ha + LAMBDA)
        value = lambda kind, node: repr(float(leaf.get((kind, node), 0.0)))  # noqa: B023, E731
        model.trees.append(_by_kind({k: _tree(splits, value, k, 1, DEPTH) for k in model.prior}))
        done, train = train, train.withColumn("margin", F.expr(f"margin + {model.trees[-1]}")).cache()
        train.count()
        done.unpersist()
    train.unpersist()
    return model


def calibrate(model: Trees, table: DataFrame) -> Trees:
    """The least margin of each kind at which what is held out, from there upwards, is right in ``PRECISION`` of the
    cases, by the rule of succession."""
    if model.prior:
        held = table.where(F.col("held_out")).withColumn("margin", F.round(model.margin(), 3)).where("margin IS NOT NULL")
        held = held.groupBy("kind", "margin").agg(F.expr("sum(w * y) AS good"), F.expr("sum(w) AS every"))
        down = "OVER (PARTITION BY kind ORDER BY margin DESC ROWS UNBOUNDED PRECEDING)"
        held = held.selectExpr("kind", "margin", f"(sum(good) {down} + 1) / (sum(every) {down} + 2) AS right")
        for r in held.where(F.col("right") >= PRECISION).groupBy("kind").agg(F.min("margin").alias("margin")).collect():
            model.thresholds[r.kind] = float(r.margin) - 0.0005
    return model


def learn(spans: DataFrame) -> Trees:
    table = lessons(spans)
    return calibrate(boost(table), table)


def selected(spans: DataFrame, model: Trees) -> DataFrame:
    """(row, doc_id, kind, start, end, base, margin) of the spans that count, and one row without a kind for each
    document: ``spans`` as ``near_base`` gives them."""
    limit = F.expr(_by_kind({k: repr(x) for k, x in model.thresholds.items()})).cast("double")
    margin = model.margin()
    told = spans.where((F.col("source") <= _FOUND) | F.col("kind").isNull()).select("row", "doc_id", "kind", "source", "start", "end", "touches", margin.alias("margin"))
    base = F.col("kind").isNotNull() & (F.col("source") == _BASE)
    more = F.col("kind").isNotNull() & (F.col("source") == _FOUND) & ~F.col("touches") & F.coalesce(F.col("margin") >= limit, F.lit(False))
    told = told.withColumn("base", base).withColumn("more", more)
    before = Window.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("start") >= F.coalesce(F.max(F.when(F.col("more"), F.col("end"))).over(before), F.lit(0))
    told = told.withColumn("fresh", (F.col("more") & fresh).cast("int"))
    upto = Window.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn("chain", F.sum("fresh").over(upto))
    best = F.row_number().over(Window.partitionBy("row", "chain", "more").orderBy(F.desc("margin"), "start", "kind"))
    told = told.withColumn("kept", F.col("base") | (F.col("more") & (best == 1)))
    return told.select("row", "doc_id", F.when(F.col("kept"), F.col("kind")).alias("kind"), "start", "end", F.col("kept") & F.col("base"), "margin").toDF(
        "row", "doc_id", "kind", "start", "end", "base", "margin"
    )


def find(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """Spans of every document, by a model learned from ``docs`` unless one is given."""
    spans = near_base(candidates(docs))
    if model is None:
        spans = save(spans, "personal-spans")
        model = learn(spans)
    return selected(spans, model)


def by_document(found: DataFrame) -> DataFrame:
    """(row, doc_id, n_email, n_ip, n_card, n_phone, base, spans): counts of base spans, and sorted (start, kind, end)."""
    place = F.struct("start", "kind", "end")
    ours = F.col("kind").isNotNull()
    return found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *(F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sort_array(F.collect_list(F.when(F.col("base"), place))).alias("base"),
        F.sort_array(F.collect_list(F.when(ours, place))).alias("spans"),
    )


def listed(spans: Column) -> Column:
    names = F.array(*(F.lit(x) for x in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; of spans that overlap, what an earlier one
    has left. Takes tables that come from files or were saved, and keeps all columns."""
    spans = by_document(find(docs, model)).where(F.size("spans") > 0).select("row", "spans")
    kept = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"))
    told = kept.join(spans, "row", "left").select("doc", "spans")
    text, names = F.col("doc.text"), F.array(*(F.lit(f"[{x.upper()}]") for x in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        gap = text.substr(acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(gap, F.get(names, s["kind"]))).alias("out"))
        )

    end = lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text)))
    clean = F.when(F.col("spans").isNull(), text).otherwise(F.aggregate("spans", start, step, end))
    return told.select(F.col("doc").withField("text", clean).alias("doc")).select("doc.*")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = by_document(find(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select(
        "doc_id", *(f"n_{name}" for name in KINDS), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


#: Trees that are learned from the data have no SQL; the tests hold the base part against brute force.
QUERIES = {"op13_personal_data": op13_personal_data}
ORACLES = {}
