"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Two first-order Markov models over the characters of tokens are trained from labelled samples. A token's score is the mean
log-likelihood ratio of its transitions under the two models; tokens over a threshold, calibrated so that at most
FALSE_RATE of the ordinary samples pass, are added to what the patterns find. Tokens under LONG characters have models
of their own, whose ordinary samples hold words of any letters too, and a threshold for each length. A pattern's matches always stay.

Everything is column expressions inside the scan: no shuffle, no Python on executors. The model is a table of as many
numbers as there are pairs of ASCII characters; its training reads the samples only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalfold.llm.common import read

# The kinds in their order, their patterns and least lengths (of group 2 for assign, else of the match).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 12, "access": 18, "hex": 16, "markov": 12}

#: Characters and least length of the tokens that the models judge.
TOKEN = r"[A-Za-z0-9+/_=-]{12,}"
CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Labelled samples of each class that train the models (a documented bound), and the share of ordinary ones let through.
SAMPLES, FALSE_RATE = 6000, 0.001
#: Length from which tokens share one threshold.
LONG = 20
#: Matches whose lengths are summed together when positions are computed.
STRIDE = 256

_WORDS = (
    "get set read write open close load store index value count total user name file path table column row key item list map node edge left right first last next start "
    "stop time date year month day hour minute second size length width height input output error result return parse format string number int float double buffer queue "
    "stack tree graph thread process task job batch window stream event message request response client server session cache config option default update delete insert "
    "select create remove find search match replace split join merge sort filter group order limit offset page view model controller service handler manager factory builder"
).split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(values: Column, add: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """Of each element, the sum (or what `add` makes from 0) of the elements before it; about STRIDE steps for each, not as many
    as there are elements."""
    blocks = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STRIDE).cast("int"))).otherwise(F.array().cast("array<int>"))
    part = lambda b: F.slice(values, b * STRIDE + 1, STRIDE)
    totals = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0), add))
    return let(totals, lambda t: F.flatten(F.transform(t, lambda _, b: let(part(b), lambda p: let(
        F.aggregate(F.slice(t, F.lit(1), b), F.lit(0), add),
        lambda base: F.transform(p, lambda _, i: F.aggregate(F.slice(p, F.lit(1), i), base, add)),
    )))))


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<struct<start:int,kind:int,end:int,text:{kind}>>")


def matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as structs (start, kind, end, text): code points, end exclusive; text is the group's."""
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("text"))

    def placed(z: Column) -> Column:
        lengths = F.transform(z, lambda e: F.length(e["gap"]) + F.coalesce(F.length(e["all"]), F.lit(0)))
        rows = F.transform(F.arrays_zip(z.alias("e"), let(lengths, lambda x: _before(x)).alias("at")), lambda r: F.struct(
            (r["at"] + F.length(r["e"]["gap"])).alias("start"), F.lit(kind).alias("kind"),
            (r["at"] + F.length(r["e"]["gap"]) + F.length(r["e"]["all"])).alias("end"), r["e"]["text"].alias("text"),
        ))
        return F.filter(rows, lambda r: r["text"].isNotNull())  # the last gap has no match

    return F.when(text.rlike(pattern), let(found, placed)).otherwise(_empty("string"))


def _secret() -> Column:
    """A random string of the row's id in one of four alphabets."""
    base64 = F.translate(F.base64(F.unhex(F.sha2(F.concat(F.col("id").cast("string"), F.lit("/a")), 512))), "\r\n", "")
    return F.when(F.col("id") % 4 == 0, F.translate(base64, "+/", "xY")).when(F.col("id") % 4 == 1, base64).when(F.col("id") % 4 == 2, F.upper(F.translate(base64, "+/=", "q7z"))).otherwise(F.translate(base64, "+/", "-_"))


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(token, random) rows made from hashes of a counter: random strings in several alphabets; identifiers, words, numbers."""
    size = (F.lit(20) + F.pmod(F.xxhash64("id"), F.lit(28))).cast("int")
    words = F.array(*map(F.lit, _WORDS))
    word = lambda i: F.get(words, F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(_WORDS))).cast("int"))
    five = F.array(*map(word, range(5)))
    camel = F.array_join(F.transform(five, lambda w: F.initcap(w)), "")
    plain = (
        F.when(F.col("id") % 6 == 0, F.array_join(five, "_")).when(F.col("id") % 6 == 1, F.array_join(five, "-")).when(F.col("id") % 6 == 2, camel)
        .when(F.col("id") % 6 == 3, F.upper(F.array_join(five, "_"))).when(F.col("id") % 6 == 4, F.concat(F.array_join(five, "/"), (F.pmod(F.xxhash64("id"), F.lit(100))).cast("string")))
        .otherwise(F.concat(F.array_join(five, ""), F.repeat(F.lit("=-"), 3), F.abs(F.xxhash64("id", F.lit(9))).cast("string")))
    )
    ids = spark.range(n)
    return ids.select(F.substring(_secret(), F.lit(1), size).alias("token"), F.lit(True).alias("random")).unionByName(ids.select(plain.alias("token"), F.lit(False).alias("random")))


def short_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(token, random) rows, `n` of each class and length under LONG: random strings; identifiers, numbers, dates, and any letters of one case."""
    words = F.array(*map(F.lit, _WORDS))
    lengths = LONG - LEAST["markov"]
    i, size = F.floor(F.col("id") / (4 * lengths)) * 4 + F.col("id") % 4, (F.floor(F.col("id") / 4) % lengths + LEAST["markov"]).cast("int")
    h = lambda salt: F.abs(F.xxhash64("id", F.lit(salt)))
    five = F.array(*(F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(_WORDS))).cast("int")) for k in range(6)))
    camel = F.array_join(F.transform(five, lambda w: F.initcap(w)), "")
    digits = F.lpad(h("digits").cast("string"), LONG, "7")
    letters = F.regexp_replace(F.lower(F.base64(F.unhex(F.sha2(F.concat(F.col("id").cast("string"), F.lit("/letters")), 512)))), "[^a-z]", "")
    styles = [
        letters, F.initcap(letters), F.upper(letters),
        F.array_join(five, "_"), F.array_join(five, "-"), camel, F.upper(F.array_join(five, "_")), F.array_join(five, "/"), F.array_join(five, ""), F.concat(F.lower(F.substring(camel, 1, 1)), F.substring(camel, 2, LONG)),
        F.concat(F.get(five, F.lit(0)), digits), F.concat(F.get(five, F.lit(0)), F.get(five, F.lit(1)), F.lit("_"), digits), digits, F.concat(F.date_add(F.lit("2000-01-01").cast("date"), (h("day") % 20_000).cast("int")).cast("string"), F.lit("T"), digits),
    ]
    style = F.element_at(F.array(*styles), (i % len(styles) + 1).cast("int"))
    ids = spark.range(n * lengths)
    return ids.select(F.substring(_secret(), F.lit(1), size).alias("token"), F.lit(True).alias("random")).unionByName(ids.select(F.substring(style, F.lit(1), size).alias("token"), F.lit(False).alias("random")))


def _code(token: Column, i: Column) -> Column:
    return F.ascii(F.substring(token, i, F.lit(1)))


def score(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of the token's transitions, in nats; 0 for a token of one character."""
    ratios = F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<double>")  # folded to one literal
    steps = F.sequence(F.lit(1), F.length(token) - 1)
    total = F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.coalesce(F.get(ratios, _code(token, i) * 128 + _code(token, i + 1)), F.lit(0.0)))
    return F.when(F.length(token) > 1, total / (F.length(token) - 1)).otherwise(F.lit(0.0))


def train(samples: DataFrame, false_rate: float = FALSE_RATE) -> tuple[list[float], float]:
    """The table of log ratios by pair of characters, and the threshold.

    Counts are add-one smoothed over CHARS. Samples with a null token or label, or under two characters, teach nothing.
    Without samples every ratio is 0 and nothing passes.
    """
    known = samples.filter(F.col("token").isNotNull() & F.col("random").isNotNull() & (F.length("token") > 1)).select("token", "random")
    pairs = known.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2)))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.filter(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = [0.0] * (128 * 128)
    for a in CHARS:
        row = {label: sum(counts.get((label, a + b), 0) + 1 for b in CHARS) for label in (True, False)}
        for b in CHARS:
            p, q = ((counts.get((label, a + b), 0) + 1) / row[label] for label in (True, False))
            table[ord(a) * 128 + ord(b)] = math.log(p / q)
    passed = known.filter(~F.col("random")).agg(F.percentile_approx(score(F.col("token"), table), 1 - false_rate, 100_000)).first()[0]
    return table, max(0.0, passed) if passed is not None else math.inf


def train_short(samples: DataFrame, false_rate: float = FALSE_RATE) -> tuple[list[float], list[float]]:
    """The table of log ratios for tokens under LONG, and the threshold of each length from the least; inf where no ordinary sample has it."""
    table, _ = train(samples, false_rate)
    plain = samples.filter(~F.col("random") & F.length("token").between(LEAST["markov"], LONG - 1))
    passed = dict(plain.groupBy(F.length("token")).agg(F.percentile_approx(score(F.col("token"), table), 1 - false_rate, 100_000)).collect())
    return table, [max(0.0, passed.get(n, math.inf)) for n in range(LEAST["markov"], LONG)]


def find_secrets(docs: DataFrame, table: list[float], threshold: float, short: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """`docs` with `base` and `added`: arrays of (start, kind, end), kind a number in KINDS, each sorted.

    short: what train_short gives for tokens under LONG; without it such tokens aren't judged. A null or empty text has no
    span. An added span never lies wholly inside a base span. Existing columns of these names are replaced; other columns
    pass through.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    least = lambda kind: lambda r: F.length(r["text"]) >= LEAST[kind]
    found = F.concat(F.filter(matches(text, ASSIGN, 0, 2), least("assign")), F.filter(matches(text, ACCESS, 1), least("access")), _hex(text))
    bare = lambda rows: F.array_sort(F.transform(rows, lambda r: F.struct(r["start"], r["kind"], r["end"])))
    tokens = matches(text, TOKEN, 3)
    score_long = lambda t: score(t["text"], table) > threshold
    if short is not None:
        passing = F.array(*map(F.lit, short[1]))
        random = lambda t: F.when(F.length(t["text"]) >= LONG, score_long(t)).otherwise(score(t["text"], short[0]) > F.get(passing, F.length(t["text"]) - LEAST["markov"]))
    else:
        random = lambda t: (F.length(t["text"]) >= LONG) & score_long(t)
    return docs.withColumn("base", bare(found)).withColumn("added", let(bare(F.filter(tokens, random)), lambda spans: F.when(F.size(spans) > 0, _outside(spans, F.col("base"))).otherwise(spans)))


def _outside(spans: Column, base: Column) -> Column:
    """The spans that lie wholly inside no base span, by a sweep: at a span's start, the furthest end of the base spans that
    start there or before must fall short of its end."""
    marked = lambda x, is_base: F.transform(x, lambda r: F.struct(r["start"].alias("start"), F.lit(0 if is_base else 1).alias("later"), r["kind"].alias("kind"), r["end"].alias("end")))
    events = F.array_sort(F.concat(marked(base, True), marked(spans, False)))
    swept = let(events, lambda e: let(
        let(F.transform(e, lambda r: F.when(r["later"] == 0, r["end"]).otherwise(0)), lambda v: _before(v, lambda a, x: F.greatest(a, x))),
        lambda ends: F.filter(F.arrays_zip(e.alias("e"), ends.alias("reached")), lambda z: (z["e"]["later"] == 1) & (z["reached"] < z["e"]["end"])),
    ))
    return F.transform(swept, lambda z: F.struct(z["e"]["start"].alias("start"), z["e"]["kind"].alias("kind"), z["e"]["end"].alias("end")))


def _hex(text: Column) -> Column:
    # A maximal run of hex digits matches whole, so runs of the least length are the matches that pass.
    return matches(text, HEX[:-1] + f"{{{LEAST['hex']},}}", 2)


def render(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda r: F.concat_ws(":", F.get(names, r["kind"]), r["start"].cast("string"), r["end"].cast("string"))), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"), *train(labelled_samples(spark)), train_short(short_samples(spark)))
    of = lambda c, k: F.size(F.filter(c, lambda r: r["kind"] == k)).cast("long")
    return found.select(
        "doc_id", of("base", 0).alias("n_assign"), of("base", 1).alias("n_access"), of("base", 2).alias("n_hex"), F.size("added").cast("long").alias("n_markov"),
        F.sha2(render(F.col("base")).cast("binary"), 256).alias("base_sha256"), render(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
