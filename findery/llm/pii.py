"""Personal data: fixed patterns, and further spans that boosted trees select from candidates.

DataFrame functions only.  High-recall generators propose spans that may overlap, trees score each by
its format and its context, a threshold calibrated on examples decides, and of overlapping spans the
likelier stays.  Spans of the fixed patterns always stay.

Positions come from running sums over arrays, made by doubling, and pieces of a text from slices of
fixed length, so the time for a text grows with its length times the logarithm of its matches.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.llm.common import let, running, unused
from findery.llm.pii_examples import examples
from findery.llm.trees import Boosted, boost

KINDS = ("email", "ip", "card", "phone")
#: A kind of the method alone: passwords, keys and tokens.
SECRET = "secret"
# The patterns of the four kinds.  Runs are possessive and start where a run starts or the
# last match ended, which finds the same matches in time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates beyond the patterns: addresses spelt out, numbers grouped in any way, numbers within longer
#: runs that are grouped like a telephone number, long mixed tokens, and what follows a word for a password.
#: Tokens and passwords have no greatest length; as tokens start where a run starts, looking ahead costs a run's length.
_AT = r"\x20?(?:@|\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?"
_DOT = r"(?:\.|\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20)"
_GAP = r"[\x20().:/_-]"
GENERATORS = {
    "spelt": rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "number": rf"(?:(?<![0-9A-Za-z.#$])(?<![0-9]{_GAP}{{1,3}})[0-9]|[+(]{{1,2}}[0-9])(?:{_GAP}{{0,3}}[0-9]){{6,23}}+(?!{_GAP}{{0,3}}[0-9])(?![A-Za-z%])",
    "grouped": r"(?<![0-9A-Za-z.#$])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9A-Za-z%])",
    "token": r"(?<![A-Za-z0-9_+/.-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+={0,2}+(?![A-Za-z0-9_+/=.-]{1,2}[A-Za-z0-9])",
    "password": r"(?i)(?<=(?:password|passwd|passwort|contraseña|pwd)[\"']{0,1}\x20{0,2}[:=]\x20{0,2}[\"']{0,1})[^\s\"',;:=]{4,}+",
}
GATES = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]",
    "spelt": r"@|(?: |\(|\[|\{)at[ )\]}]", "number": r"[0-9](?:[^0-9]{0,3}[0-9]){6}", "grouped": r"[0-9][\x20./-][0-9]{3}", "token": r"[0-9_+/-][A-Za-z]|[A-Za-z][0-9_+/-]", "password": r"(?i)pass|pwd|contra",
}
#: Words before a candidate that speak for a kind; part of the format of the features.
CUES = {
    "cue_phone": r"(?i)(?:\btel|phone|telefon|téléphone|teléfono|\bcall|\bfax|mobile|handy|whatsapp|\bsms|\bring)[^\n]{0,16}$",
    "cue_card": r"(?i)(?:card|karte|carte|tarjeta|visa|mastercard|amex|payment|paid|\bpan\b)[^\n]{0,16}$",
    "cue_mail": r"(?i)(?:mail|contact|write|kontakt|correo|courriel|reach)[^\n]{0,16}$",
    "cue_secret": r"(?i)(?:token|secret|api.?key|access.?key|private.?key|bearer|passw|pwd|credential|contraseña)[^\n]{0,12}$",
    "cue_other": r"(?i)(?:order|invoice|version|\bref|\bid\b|isbn|date|no\.|nr\.|page|total|serial|\blot|commit|sha|md5|checksum|etag|build|uuid|digest|revision|#)[^\n]{0,16}$",
}
#: Code points before and after a candidate that its features see, up to the next candidate of its generator.
CONTEXT = 48
#: Code points of a slice of a text, from which pieces are cut.
SLICE = 256
_SHAPE = {
    "spaces": " ", "dots": r"\.", "dashes": "-", "slashes": "/", "colons": ":", "parens": "[()]", "words": "[A-Za-z]+", "capitals": "[A-Z]", "turns": "[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])",
    "at_marks": r"@|\(at\)|\[at\]|\{at\}| at ", "dot_marks": r"\(dot\)|\[dot\]|\{dot\}| dot ", "bracketed": r"[\[({](?:at|dot)[\])}]",
}
FEATURES = ["generator", "length", "digits", "groups", "longest", "first", "last", "zero", "plus", "luhn", "hex", *_SHAPE, *CUES, "equals", "quoted", "ends_text", "goes_on", "went_on"]
#: The share of false positives among accepted examples that the threshold allows.
ALLOWED_FALSE = 0.01
EXAMPLES, SEED = 4000, 11
_SPAN = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"


def _spans(text: Column, name: str, pattern: str) -> Column:
    """array<struct<start, end, hit, before, after>> of a pattern's matches, positions in code points, end exclusive."""

    def placed(hits: Column, between: Column) -> Column:
        sizes = F.zip_with(hits, F.slice(between, 1, F.size(hits)), lambda m, b: F.length(m) + F.length(b))
        return let(
            running(sizes, lambda a, b: a + b),
            lambda ends: F.transform(
                hits,
                lambda hit, i: F.struct(
                    (F.get(ends, i) - F.length(hit)).alias("start"), F.get(ends, i).alias("end"), hit.alias("hit"),
                    F.right(F.get(between, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(between, i + 1), F.lit(CONTEXT)).alias("after"),
                ),
            ),
        )

    some = let(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), lambda hits: F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), lambda between: placed(hits, between))))
    return F.coalesce(F.when(text.rlike(GATES[name]), some), F.array().cast(_SPAN))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the check: from the right every second digit counts double, less 9 above 9."""
    value = lambda d, k: F.get(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), d) if k else d
    at = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, value(c.cast("int"), 1)).otherwise(c.cast("int")))
    return F.aggregate(at, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    if kind == "ip":
        # leading zeros don't count; without them a part has 3 digits at most
        bare = lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.forall(F.split(hit, r"\."), lambda part: (F.length(bare(part)) <= 3) & (F.substring(bare(part), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(hit))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _features(c: Column, generator: int) -> dict[str, Column]:
    """FEATURES of a candidate: numbers, all as double."""
    hit, before, after = c["hit"], c["before"], c["after"]
    count = lambda p: F.size(F.regexp_extract_all(hit, F.lit(f"({p})"), 1))
    digits = _digits(hit)
    n = F.length(digits)
    sizes = F.transform(F.filter(F.split(hit, "[^0-9]+"), lambda g: g != ""), lambda g: F.length(g))
    found = {
        "generator": F.lit(generator), "length": F.length(hit), "digits": n, "groups": F.size(sizes), "longest": F.coalesce(F.array_max(sizes), F.lit(0)), "first": F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)), "last": F.coalesce(F.try_element_at(sizes, F.lit(-1)), F.lit(0)),
        "zero": digits.startswith("0"), "plus": hit.startswith("+"), "luhn": F.when(n.between(13, 19), _luhn(digits)).otherwise(False), "hex": hit.rlike("^[0-9a-f]+$"),
        **{k: count(p) for k, p in _SHAPE.items()}, **{k: before.rlike(p) for k, p in CUES.items()},
        "equals": before.rlike(r"[:=]\x20?[\"']?$"), "quoted": before.rlike("[\"'(<]$"), "ends_text": after.rlike(r"^[\x20\n.,;)\"'>]|^$"),
        "goes_on": after.rlike(rf"^{_GAP}{{0,3}}[0-9]"), "went_on": before.rlike(rf"[0-9]{_GAP}{{0,3}}$"),
    }
    return {k: found[k].cast("int").cast("double") for k in FEATURES}


def _kind(generator: str, f: Column) -> Column:
    if generator in ("number", "grouped"):
        return F.when((f["digits"] >= 13) & ((f["luhn"] == 1) | (f["cue_card"] == 1)), "card").otherwise("phone")
    return F.lit("email" if generator == "spelt" else SECRET)


def _candidates(text: Column) -> Column:
    """array<struct<start, end, kind, f>>: all that the generators propose, each with its features."""

    def shaped(generator: str, k: int) -> Column:
        def one(c: Column) -> Column:
            f = F.struct(*[x.alias(name) for name, x in _features(c, k).items()])
            return let(f, lambda f: F.struct(c["start"].alias("start"), c["end"].alias("end"), _kind(generator, f).alias("kind"), f.alias("f")))

        return F.transform(_spans(text, generator, GENERATORS[generator]), one)

    return F.concat(*[shaped(g, k) for k, g in enumerate(GENERATORS)])


def _scored_examples(spark: SparkSession, rows: list[dict]) -> list[tuple[int, str, int, np.ndarray]]:
    """(example, kind, whether its span is personal and nearly the candidate, features) of every candidate in examples.

    Nearly: what both have is over four fifths of what either has.
    """
    shape = "array<struct<text:string,start:int,end:int,label:int,kind:string>>"
    table = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(rows)), shape)).alias("k", "e")).select("k", "e.*")
    found = table.select("k", "kind", "label", "start", "end", F.explode(_candidates(F.col("text"))).alias("c"))
    both = F.least(F.col("c.end"), F.col("end")) - F.greatest(F.col("c.start"), F.col("start"))
    near = 5 * both > 4 * (F.greatest(F.col("c.end"), F.col("end")) - F.least(F.col("c.start"), F.col("start")))
    got = found.select("k", "kind", (F.col("label") * near.cast("int")).alias("y"), F.array(*[F.col(f"c.f.{name}") for name in FEATURES]).alias("x")).collect()
    return [(r.k, r.kind, r.y, np.array(r.x)) for r in sorted(got, key=lambda r: (r.k, r.x))]


_models: dict[str, tuple[Boosted, float]] = {}


def model(spark: SparkSession) -> tuple[Boosted, float]:
    """Trees and threshold, trained once for a process on EXAMPLES invented sentences.

    Of every four examples three grow the trees; the fourth calibrates their probability and the threshold.
    """
    if "trees" not in _models:
        got = _scored_examples(spark, examples(EXAMPLES, SEED))
        x, y = np.array([f for *_, f in got]), np.array([y for _, _, y, _ in got], np.float64)
        held = np.array([k // 10 % 4 == 3 for k, *_ in got])
        trees = boost(FEATURES, x, y, held)
        p = 1 / (1 + np.exp(-(trees.raw(x[held]) * trees.slope + trees.shift)))
        order = np.argsort(-p, kind="stable")
        false = np.cumsum(1 - y[held][order]) / np.arange(1, held.sum() + 1)
        good = np.flatnonzero(false <= ALLOWED_FALSE)
        _models["trees"] = trees, min(0.9, max(0.5, float(p[order[good[-1]]]))) if len(good) else 2.0
    return _models["trees"]


def _covered(spans: Column) -> Column:
    """Before each span, in order of start: how far the spans before it reach (0 before the first)."""
    ends = F.transform(spans, lambda s: s["end"])
    return F.concat(F.array(F.lit(0)), running(ends, F.greatest))


def _slices(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SLICE}}}"), 0)


def _cut(slices: Column, a: Column, b: Column) -> Column:
    """Code points a to b (exclusive) of a text, from the slices that hold them only."""
    first = F.floor(a / SLICE).cast("int")
    many = F.floor((b - 1) / SLICE).cast("int") - first + 1
    return F.when(b > a, F.substring(F.array_join(F.slice(slices, first + 1, many), ""), a % SLICE + 1, b - a)).otherwise("")


def _replaced(text: Column, spans: Column, put: Callable[[Column, Column], Column]) -> Column:
    """The text with spans (sorted by start, at least one) replaced; ``put(span, reach)`` is what stands for a span
    when those before it reach so far."""

    def joined(slices: Column, reach: Column) -> Column:
        pieces = F.transform(spans, lambda s, i: F.concat(_cut(slices, F.get(reach, i), s["start"]), put(s, F.get(reach, i))))
        rest = let(F.try_element_at(reach, F.lit(-1)), lambda a: F.concat(_cut(slices, a, F.floor((a + SLICE) / SLICE).cast("int") * SLICE), F.array_join(F.slice(slices, F.floor(a / SLICE).cast("int") + 2, F.size(slices)), "")))
        return F.concat(F.array_join(pieces, ""), rest)

    return let(_slices(text), lambda slices: let(_covered(spans), lambda reach: joined(slices, reach)))


def _likeliest(scored: Column) -> Column:
    """Of accepted candidates that overlap the likeliest stays, then the first; chains of overlaps are solved one by one."""

    def solved(chain: Column) -> Column:
        none = F.array().cast("array<struct<p:double,start:int,end:int,kind:string>>")
        keep = lambda acc, c: F.when(F.exists(acc, lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"])), acc).otherwise(F.concat(acc, F.array(c)))
        ranked = F.array_sort(F.transform(chain, lambda c: F.struct((-c["p"]).alias("p"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
        return F.when(F.size(chain) > 1, F.aggregate(ranked, none, keep)).otherwise(ranked)

    def chains(spans: Column, reach: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: F.get(spans, i)["start"] >= F.get(reach, i))
        return let(heads, lambda heads: F.flatten(F.transform(heads, lambda h, k: solved(F.slice(spans, h + 1, F.coalesce(F.get(heads, k + 1), F.size(spans)) - h)))))

    return let(F.array_sort(scored), lambda spans: let(_covered(spans), lambda reach: chains(spans, reach)))


def found_in(text: Column, spark: SparkSession) -> Column:
    """struct<base, added>, both array<struct<kind, start, end>> in code points, of a text column.

    base has the valid matches of PATTERNS, by kind and start.  Candidates are sought in the text with
    base spans blanked out, so they overlap none; added has those that the trees accept, of kind email,
    card, phone or secret, by start.  A null or empty text has none.  Whole texts are searched, however long.
    """
    trees, threshold = model(spark)
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def valid(t: Column, kind: str) -> Column:
        hits = F.filter(_spans(t, kind, PATTERNS[kind]), lambda s: _valid(kind, s["hit"]))
        return F.transform(hits, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def blanked(t: Column, base: Column) -> Column:
        ordered = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        blank = lambda s, reach: F.repeat(F.lit("\x00"), F.greatest(s["end"] - F.greatest(s["start"], reach), F.lit(0)))
        return F.when(F.size(base) > 0, let(ordered, lambda o: _replaced(t, o, blank))).otherwise(t)

    def added(t: Column) -> Column:
        scored = F.transform(_candidates(t), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), trees.column(lambda name: c["f"][name]).alias("p")))
        accepted = F.filter(scored, lambda c: c["p"] >= threshold)
        shown = lambda kept: F.transform(F.array_sort(F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
        return let(accepted, lambda a: F.when(F.size(a) > 0, shown(_likeliest(a))).otherwise(none))

    whole = lambda t: let(F.concat(*[valid(t, k) for k in KINDS]), lambda base: F.struct(base.alias("base"), added(blanked(t, base)).alias("added")))
    return let(F.coalesce(text, F.lit("")), whole)


def personal_data(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id) with base and added of every row, as in ``found_in``.

    Repeated rows each get their row, no row is moved, an empty table gives an empty one; other columns
    of the input may have any names.
    """
    name = unused(docs, "found")
    rows = docs.select(*keep or ["doc_id"], found_in(F.col("text"), docs.sparkSession).alias(name))
    return rows.select(*keep or ["doc_id"], F.col(f"{name}.base"), F.col(f"{name}.added"))


def by_kind(spans: Column) -> Column:
    """Spans in the order of KINDS and SECRET, then start, then end."""
    ranked = F.transform(spans, lambda s: F.struct(F.array_position(F.lit([*KINDS, SECRET]), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(ranked)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(by_kind(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or union of overlapping spans, replaced by ``[KIND]`` of the first; null stays null."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    mark = lambda s, reach: F.when(s["start"] >= reach, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
    return let(ordered, lambda o: F.when(F.size(o) > 0, _replaced(text, o, mark)).otherwise(text))
