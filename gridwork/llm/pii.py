"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Generators of high recall propose overlapping spans of five kinds: email, ip,
card, phone and secret (keys and tokens). Boosted trees score each candidate
from its format and from the text around it, and a threshold per kind, calibrated
for precision on rows that the trees have not seen, selects what is redacted.
Spans of the base patterns (see ``BASE``) are personal data by definition: they
always stay, and the trees add spans of freer formats. Of chosen spans of one kind
that overlap, base ones stay first, then those of higher score.

The trees are fitted by Spark's own gradient boosting on a bounded, labelled set
(``EXAMPLES`` texts from ``pii_examples``: every surface form occurs as an item
and as a look-alike, so only checks and surroundings tell them apart; a
candidate is right if it is exactly the item), so neither the model nor its size
depends on the corpus. They become one expression, and detection is a
projection: no exchange, no state, and every row on its own.

Defined results: a null text counts as empty; a text without spans gives zero
counts and the digest of an empty string; positions are code points, end
exclusive; texts of any length are searched whole; rows that repeat are searched
alike; an empty table gives no rows; a column named as the result is replaced,
all others are left alone.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The kinds of base patterns, and the one that only the method adds.
ALL_KINDS = (*KINDS, "secret")

#: Base patterns. Each finds what the plain pattern beside it finds, leftmost
#: and non-overlapping, but cannot step back over a run again and again.
#:   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#:   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#:   card   [0-9]([ -]?[0-9])+
#:   phone  \+[0-9][ ().0-9-]+[0-9]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_NAME, _HOST = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+", r"[A-Za-z0-9-]{1,63}+"
#: Generators of high recall: whatever might be an item, and much that is none.
GENERATORS = (
    ("email", rf"{_NAME} ?[\[({{<] ?(?i:at) ?[\])}}>] ?{_HOST}(?:[.][A-Za-z0-9-]{{2,24}}+| ?[\[({{<] ?(?i:dot) ?[\])}}>] ?[A-Za-z0-9-]{{2,24}}+){{1,4}}"),
    ("email", rf"{_NAME} (?i:at) {_HOST}(?:[.][A-Za-z0-9-]{{2,24}}+){{1,4}}"),
    ("email", rf"{_NAME} (?i:at) {_HOST}(?: (?i:dot) [A-Za-z0-9-]{{2,24}}+){{1,4}}"),
    ("email", rf"{_NAME} ?@ ?{_HOST}(?:[.][A-Za-z0-9-]{{2,24}}+){{0,4}}"),
    ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?: ?\[?[.]\]? ?[0-9]{1,3}){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){12,18}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z+])\(?[0-9]{1,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,8}\)?){1,5}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+.])[0-9]{7,12}(?![0-9A-Za-z])"),
    ("secret", r"(?<![A-Za-z0-9_+/=.-])(?=[A-Za-z_+/=.-]{0,127}[0-9])(?=[0-9_+/=.-]{0,127}[A-Za-z])[A-Za-z0-9_+/=.-]{16,128}(?<![.])(?![A-Za-z0-9_+/=-])"),
)
#: A cheap sign without which a text has no candidate at all.
SIGN = r"[0-9]|@|[\[({<] ?(?i:at) ?[\])}>]| (?i:at) \S++(?: (?i:dot) |(?<=[A-Za-z0-9-][.][A-Za-z]{2,9}))"

#: Code points of context on either side, texts of the generated set, precision to hold, rounds and depth of the trees.
AROUND, EXAMPLES, PRECISION, ROUNDS, DEPTH = 28, 9000, 0.95, 14, 5

#: Words that tell a kind, and words that tell against all.
TELLING = {
    "email": "e-?mails?|mail|contact|write|reach|inbox|courriel|correo|mailto|address|send|from",
    "ip": "ips?|ipv[46]|host|server|gateway|subnet|ping|dns|connect|address|login|client|node|router",
    "card": "cards?|visa|mastercard|amex|credit|debit|payment|paid|cc|karte|carte|tarjeta|charge|charged",
    "phone": "phone|tel|telephone|call|mobile|fax|cell|whatsapp|sms|dial|telefon|ring|text|hotline|number",
    "secret": "tokens?|key|secret|passwords?|passwd|pwd|api|api_key|auth|bearer|credentials?|access|private",
}
MISLEADING = ("version|release|orders?|invoice|isbn|section|figure|parts?|serial|build|chapter|ratio|article|no|nr|ref|id|sku|tracking|ticket|commit|sha|sha1|checksum|md5|pages?|"
              "date|dated|year|population|score|scored|coordinates|lat|lon|mac|time|file|image|slug|between|total|batch|item|model|rev|digest|hash|uuid|meet|look|arrived|stayed")
#: Ends of common domains.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|dev|app|me|co|eu|de|fr|es|it|nl|be|ch|at|uk|us|ca|au|br|mx|ar|jp|cn|in|ru|pl|se|no|dk|fi|pt|ie"
SPAN = "struct<kind:int,start:int,end:int,base:boolean,match:string>"
KIND = f"array<{SPAN}>"
#: Items of a walk's segment; code points of a block.
CHUNK, BLOCK = 64, 1024


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, and not copied as ``transform`` would do."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, F.get(doubled, d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """The base check of a match."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.length(digits(match)).between(16, 19) & luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    return F.lit(True)


def walk(items: Column, start: Column, step, kind: str, end=None) -> Column:
    """What ``step`` (of state and item: the next state, and what comes out or null) puts out along an array of items, as an array of ``kind``.

    ``aggregate`` copies what it holds at every step, so what comes out must not
    pile up in it: the items are cut into segments of CHUNK, a first walk that puts
    nothing out finds the state at each segment's start, and then every segment
    puts out its own. ``end`` puts out one more thing of the last state.
    """
    none = F.array().cast(f"array<{kind}>")

    def cut_up(items: Column) -> Column:
        return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array())

    def states(segments: Column) -> Column:
        def over(held: Column, segment: Column) -> Column:
            last = F.aggregate(segment, F.element_at(held, -1), lambda s, x: step(s, x)["state"])
            return F.concat(held, F.array(last))

        return F.aggregate(segments, F.array(start), over)

    def put_out(segments: Column, at: Column) -> Column:
        def take(s: Column, x: Column) -> Column:
            put = lambda y: F.struct(y["state"].alias("state"), F.when(y["out"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(y["out"].cast(kind)))).alias("out"))
            return let(step(s["state"], x), put)

        each = F.transform(segments, lambda g, i: F.aggregate(g, F.struct(F.get(at, i).alias("state"), none.alias("out")), take, lambda s: s["out"]))
        found = F.coalesce(F.flatten(each), none)
        return found if end is None else let(end(F.element_at(at, -1)), lambda y: F.when(y.isNull(), found).otherwise(F.concat(found, F.array(y.cast(kind)))))

    return let(let(items, cut_up), lambda segments: let(states(segments), lambda at: put_out(segments, at)))


def blocks_of(text: Column) -> Column:
    """A text in blocks of BLOCK code points, in which a place is found without a walk from the text's start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, n: Column) -> Column:
    """``n`` code points of a text in blocks, from a place on."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.slice(blocks, first + 1, F.floor((start + n) / BLOCK).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), start - first * BLOCK + 1, n)


def _is_base(k: int):
    return lambda x: x["base"] & (x["kind"] == k)


def candidates(text: Column) -> Column:
    """Base spans and freer candidates of every kind.

    A pattern cuts the text once into pieces and matches, which take turns; one
    walk over the matches of all patterns finds their places.
    """
    item = "array<struct<match:string,n:int,gap:int,kind:int,base:boolean,first:boolean>>"

    def sized(k: int, pattern: str, base: bool) -> Column:
        both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0)).alias("matches"))
        each = lambda c: F.transform(c["matches"], lambda m, i: F.struct(m, F.length(m), F.length(F.get(c["pieces"], i)), F.lit(k), F.lit(base), i == 0)).cast(item)
        return F.when(F.regexp_like(text, F.lit(pattern)), let(both, each)).otherwise(F.array().cast(item))

    def step(at: Column, x: Column) -> Column:
        start = F.when(x["first"], 0).otherwise(at) + x["gap"]
        one = F.struct(x["kind"].alias("kind"), start.alias("start"), (start + x["n"]).alias("end"), x["base"].alias("base"), x["match"].alias("match"))
        return F.struct((start + x["n"]).alias("state"), one.alias("out"))

    every = F.concat(*[sized(ALL_KINDS.index(kind), pattern, True) for kind, pattern in BASE.items()], *[sized(ALL_KINDS.index(kind), pattern, False) for kind, pattern in GENERATORS])
    sound = lambda x: F.coalesce(*[F.when(_is_base(k)(x), valid(kind, x["match"])) for k, kind in enumerate(BASE)], F.lit(True))
    return F.filter(walk(every, F.lit(0), step, SPAN), sound)


def _flag(test: Column) -> Column:
    return F.when(test, 1.0).otherwise(0.0)


def features(kind: Column, match: Column, before: Column, after: Column) -> list[Column]:
    """Numbers the trees look at: the match's format, then its surroundings."""
    d = digits(match)
    words = lambda w: rf"(?i)(?<![A-Za-z]){'(?:' + w + ')'}(?![A-Za-z])"
    own = F.coalesce(*[F.when(kind == k, before.rlike(words(TELLING[name]))) for k, name in enumerate(ALL_KINDS)])
    near = F.coalesce(*[F.when(kind == k, before.rlike(words(TELLING[name]) + r"[^A-Za-z]*(?:[A-Za-z]{1,3}[^A-Za-z]*)?$")) for k, name in enumerate(ALL_KINDS)])
    return [
        kind.cast("double"), F.length(match).cast("double"), F.length(d).cast("double"),
        F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")).cast("double"),
        F.length(F.regexp_replace(match, "[^A-Za-z]", "")).cast("double"),
        F.length(F.regexp_replace(match, "[^A-Z]", "")).cast("double"),
        _flag((F.length(d) > 0) & luhn(F.when(F.length(d) > 0, d).otherwise(F.lit("0")))),
        F.size(F.array_distinct(F.split(F.lower(match), ""))).cast("double"),
        F.size(F.split(match, r"[^0-9A-Za-z]+")).cast("double"),
        F.length(F.regexp_extract(match, r"([0-9]+)[^0-9]*$", 1)).cast("double"),
        F.length(F.regexp_extract(match, r"^[^0-9]*([0-9]+)", 1)).cast("double"),
        F.when(F.length(d) > 0, F.left(d, F.lit(1))).otherwise(F.lit("-1")).cast("double"),
        _flag(match.rlike(r"^[(]?(?:(?:19|20)[0-9]{2}[-./ ]+[0-9]{1,2}[-./ ]+[0-9]{1,2}|[0-9]{1,2}[-./ ]+[0-9]{1,2}[-./ ]+(?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}[-/ ]+(?:19|20)[0-9]{2})[)]?$")),
        _flag(match.rlike(r"^(?:AKIA|ghp_|gho_|sk-|sk_|xox[bp]-|eyJ|glpat-)")),
        _flag(match.rlike("^[0-9a-fA-F]+$")),
        _flag(match.rlike(rf"(?i)(?:[.]|dot[^a-z]{{0,2}})(?:{DOMAINS})$")),
        _flag(F.forall(F.split(match, r"[^0-9]+"), lambda x: (F.length(x) == 0) | x.rlike("^(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"))),
        _flag(match.rlike("::")), F.size(F.split(match, ":")).cast("double"),
        _flag(match.rlike(r"[.+_%-][A-Za-z0-9]|[0-9]") & (kind == 0)),
        _flag(match.rlike("[()\\[{<]")),
        _flag(match.rlike(r"[a-z]{3,}[-_/.][a-z]{3,}[-_/.][a-z]{3,}")),
        _flag(own), _flag(near), _flag(before.rlike(words(MISLEADING))),
        _flag(before.rlike(words(MISLEADING) + r"[^A-Za-z]*$")),
        _flag(before.rlike(r"[A-Za-z]$") | after.rlike("^[A-Za-z]")),
        _flag(before.rlike(r"[0-9][^A-Za-z]?$") | after.rlike("^[^A-Za-z,;]?[0-9]")),
        _flag(before.rlike("[\"'`]$")), _flag(before.rlike(r"[=:] ?[\"'`]?$")), _flag(before.rlike("[#$€£/_-]$")),
        _flag(after.rlike(r"^ ?(?:%|km|kg|cm|mm|ms|px|GB|MB|EUR|USD|euros?|dollars?|people|pieces|points|years?)(?![A-Za-z])")),
    ]


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """The generated, labelled set, one row per candidate: kind, f, label, part (0 to fit on, 1 to calibrate on)."""
    from gridwork.llm.pii_examples import labelled

    rows = json.dumps([{"id": i, "text": t, "kind": k, "start": a, "end": b} for i, (t, k, a, b) in enumerate(labelled(n, 11))])
    table = spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<id:int,text:string,kind:int,start:int,end:int>>")).alias("r")).select("r.*")
    table = table.withColumn("x", F.explode(F.filter(candidates(F.col("text")), lambda x: ~x["base"])))
    right = (F.col("x.kind") == F.col("kind")) & (F.col("x.start") == F.col("start")) & (F.col("x.end") == F.col("end"))
    return table.select(F.col("x.kind").alias("kind"), F.array(*_features_at(blocks_of(F.col("text")), F.col("x"))).alias("f"), F.coalesce(right, F.lit(False)).cast("double").alias("label"), F.when(F.col("id") % 3 == 2, 1).otherwise(0).alias("part"))


def _features_at(blocks: Column, x: Column) -> list[Column]:
    left = F.least(x["start"], F.lit(AROUND))
    return features(x["kind"], x["match"], cut(blocks, x["start"] - left, left), cut(blocks, x["end"], F.lit(AROUND)))


def _as_sql(description: str, depth_first: bool = True) -> str:
    """A fitted tree's printed rules as nested CASE expressions over ``f[i]``."""
    lines = [x.strip() for x in description.splitlines() if x.strip()]
    at = 0

    def node() -> str:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return line.split(":")[1].strip()
        m = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
        left = node()
        at += 1  # the line that begins with Else
        right = node()
        return f"CASE WHEN f[{m[1]}] <= {m[2]} THEN {left} ELSE {right} END"

    return node()


_MODELS: dict = {}


def model(spark: SparkSession) -> tuple[str, list[float]]:
    """The boosted trees as SQL over an array ``f``, and each kind's threshold; fitted once per process."""
    if "it" not in _MODELS:
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.functions import array_to_vector

        rows = examples(spark).coalesce(1).persist()
        fit = rows.filter("part = 0").select("label", array_to_vector("f").alias("features"))
        trees = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, seed=1, maxBins=24, cacheNodeIds=True).fit(fit)
        parts = [f"{w!r} * ({_as_sql(t.toDebugString.split(chr(10), 1)[1])})" for t, w in zip(trees.trees, trees.treeWeights)]
        score = " + ".join(parts)
        # The lowest margin at which the kind's unseen rows are as precise as asked, in steps of a tenth.
        steps = rows.filter("part = 1").select("kind", "label", F.expr(score).alias("s")).withColumn("step", F.explode(F.array(*[F.lit(i / 10) for i in range(-10, 16)]))).filter("s >= step")
        precise = steps.groupBy("kind", "step").agg(F.avg("label").alias("p")).filter(F.col("p") >= PRECISION).groupBy("kind").agg(F.min("step").alias("t"))
        least = {r.kind: r.t for r in precise.collect()}
        rows.unpersist()
        _MODELS["it"] = score, [least.get(k, float("inf")) for k in range(len(ALL_KINDS))]
    return _MODELS["it"]


def spans_of(spark: SparkSession, text: Column) -> Column:
    """Array of (kind, start, end, base, match), sorted by kind and start, of a text that is not null."""
    score, thresholds = model(spark)
    limit = F.array(*[F.lit(float(t)) for t in thresholds])
    touch = lambda x, y: (x["kind"] == y["kind"]) & (x["start"] < y["end"]) & (y["start"] < x["end"])
    scored_kind = f"struct<kind:int,start:int,end:int,x:{SPAN},s:double>"

    def apart(spans: Column, back: bool) -> Column:
        """Sorted spans without free ones that overlap a base span of their kind which begins before them (``back``: after them)."""
        edge = lambda x: F.struct(x["kind"].alias("kind"), x["start" if back else "end"].alias("at"))

        def step(s: Column, x: Column) -> Column:
            over = (s["kind"] == x["kind"]) & ((x["end"] > s["at"]) if back else (x["start"] < s["at"]))
            return F.struct(F.when(x["base"], edge(x)).otherwise(s).alias("state"), F.when(x["base"] | ~over, x).alias("out"))

        start = F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("at"))
        return walk(F.reverse(spans) if back else spans, start, step, SPAN)

    def best(free: Column, blocks: Column) -> Column:
        """In order of place; of two that overlap the one of higher score stays, then the first."""
        scored = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x.alias("x"), let(F.array(*_features_at(blocks, x)), lambda f: _evaluate(score, f)).alias("s"))
        placed = F.array_sort(F.filter(F.transform(free, scored), lambda y: y["s"] >= F.get(limit, y["kind"])))

        def step(last: Column, y: Column) -> Column:
            meet = last["kind"].isNotNull() & touch(last, y)
            return F.struct(F.when(~meet | (y["s"] > last["s"]), y).otherwise(last).alias("state"), F.when(~meet & last["kind"].isNotNull(), last["x"]).alias("out"))

        nobody = F.lit(None).cast(scored_kind)
        return walk(placed, nobody, step, SPAN, lambda last: last["x"])

    def chosen(every: Column) -> Column:
        clear = let(apart(F.array_sort(every), False), lambda z: apart(z, True))
        return let(clear, lambda z: F.concat(F.filter(z, lambda x: x["base"]), let(blocks_of(text), lambda blocks: best(F.filter(z, lambda x: ~x["base"]), blocks))))

    # Most texts have no sign of any kind and skip all of this.
    return F.when(text.rlike(SIGN), F.array_sort(let(candidates(text), chosen))).otherwise(F.array().cast(KIND))


def spans(df: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
    """Every column of ``df`` and ``to``: array of (kind, start, end, base, match), sorted by kind and start."""
    return df.withColumn(to, spans_of(df.sparkSession, F.coalesce(F.col(text), F.lit(""))))


def _evaluate(sql: str, f: Column) -> Column:
    """The trees' SQL as a column over the array ``f``."""
    token = re.compile(r"\s*(CASE WHEN f\[(\d+)\] <= (\S+) THEN|ELSE|END|\+|\*|\(|\)|[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)")
    tokens = [m for m in token.finditer(sql)]
    at = 0

    def value() -> Column:
        nonlocal at
        m = tokens[at]
        at += 1
        if m[2] is not None:
            test = F.get(f, F.lit(int(m[2]))) <= float(m[3])
            left = value()
            at += 1  # ELSE
            right = value()
            at += 1  # END
            return F.when(test, left).otherwise(right)
        if m[1] == "(":
            inner = value()
            at += 1
            return inner
        return F.lit(float(m[1]))

    def term() -> Column:
        nonlocal at
        out = value()
        while at < len(tokens) and tokens[at][1] == "*":
            at += 1
            out = out * value()
        return out

    out = term()
    while at < len(tokens) and tokens[at][1] == "+":
        at += 1
        out = out + term()
    return out


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The same columns; every span in ``text`` becomes its kind in brackets. Spans that overlap become one, named by the first; a null text stays null."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])
    whole = F.col(text)

    def clean(found: Column) -> Column:
        by_place = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

        def joined(blocks: Column) -> Column:
            def step(at: Column, x: Column) -> Column:
                piece = F.concat(cut(blocks, at, x["start"] - at), F.get(names, x["kind"]))
                return F.struct(F.greatest(at, x["end"]).alias("state"), F.when(x["start"] >= at, piece).alias("out"))

            return F.array_join(walk(by_place, F.lit(0), step, "string", lambda at: cut(blocks, at, F.length(whole) - at)), "")

        return F.when(F.size(found) > 0, let(blocks_of(whole), joined)).otherwise(whole)

    return df.withColumn(text, F.when(whole.isNotNull(), let(spans_of(df.sparkSession, whole), clean)))


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, their digest, all spans as text, and n_spans (how many they are)."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    rows = spans(docs.select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    return rows.select(
        "doc_id", *[F.size(F.filter("spans", _is_base(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
