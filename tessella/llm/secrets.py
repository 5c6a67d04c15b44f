"""Secret scans: fixed patterns plus a randomness test battery, in DataFrame functions only.

Every run of at least ``MIN_TOKEN`` token characters is tested; '=' ends a token as its padding, and a run
that mixes the characters of both base64 alphabets is split under each of them. An encoding is inferred from
a token's characters. Two questions are put to a token:

* Could it be random? Chi-squared uniformity over the alphabet and over its halves, a runs test about the
  alphabet's middle and the lag-1 serial correlation give four p-values under "uniformly random", combined
  by Fisher's rule; a token below ``MIN_RANDOM`` is structured.
* Could it be words? ``evidence`` is the binary logarithm of the ratio of its probability under the uniform
  alphabet to that under a model of words, numbers and separators run together, with letters by frequency
  and by turns of vowels and consonants, and few changes of case and kind. Over structured tokens this ratio averages
  one at most whatever their length, so two to the power of minus the evidence is a p-value, and longer tokens can gather more of it.

False discoveries are then controlled by the step-up rule of Benjamini and Hochberg over all distinct
tokens of the corpus, apart for every encoding and length class: a token stays if its p-value is within
``max_false`` times the share of its class that has as much evidence. The rule holds in a class of one
token as in one of millions. Digits alone are never evidence: any number might be meant.

Cases: a null text counts as empty and has no spans; repeated rows are judged row by row; a null
``doc_id`` stays null; extra columns are ignored; an empty table gives no rows. Texts of any length are
scanned whole; positions are code points, ends exclusive. Of overlapping random tokens the longest stays,
of equal ones in two alphabets the one span; spans that start together are listed by kind, then end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.session import materialize

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of these classes end where the class ends, so a length floor in the pattern drops exactly the
#: matches that would be dropped afterwards.
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
MIN_VALUE = 12
NEEDLES = ("password", "passwd", "secret", "token", "api_key", "apikey")

MIN_TOKEN = 20


def _runs(chars: str) -> str:
    """Whole runs of ``chars`` with the '=' behind them; of shorter runs only those that have any."""
    return f"(?<![{chars}])(?:[{chars}]{{{MIN_TOKEN},}}+=*+|[{chars}]{{1,{MIN_TOKEN - 1}}}+=++)"


TOKEN = _runs("A-Za-z0-9+/_-")
#: The runs of either base64 alphabet.
PIECES = (_runs("A-Za-z0-9+/"), _runs("A-Za-z0-9_-"))
ENCODINGS = (
    ("digits", "0123456789", "^[0-9]+$"),
    ("lower", "abcdefghijklmnopqrstuvwxyz", "^[a-z]+$"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "^[A-Z]+$"),
    ("hex", "0123456789abcdef", "^[0-9a-f]+$"),
    ("hexu", "0123456789ABCDEF", "^[0-9A-F]+$"),
    ("b32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "^[A-Z2-7]+$"),
    ("a36", "0123456789abcdefghijklmnopqrstuvwxyz", "^[0-9a-z]+$"),
    ("a62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "^[0-9A-Za-z]+$"),
    ("b64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "^[0-9A-Za-z+/]+$"),
    ("b64u", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "^[0-9A-Za-z_-]+$"),
)
MAX_FALSE = 0.1
#: A token is structured if the battery's p-value is lower; so many random tokens are lost.
MIN_RANDOM = 0.005
#: Levels of evidence are whole bits up to this.
LEVELS = 64
#: How often each letter stands in English text, in percent.
LETTERS = {
    "a": 8.2, "b": 1.5, "c": 2.8, "d": 4.3, "e": 12.7, "f": 2.2, "g": 2.0, "h": 6.1, "i": 7.0, "j": 0.15, "k": 0.77, "l": 4.0, "m": 2.4,
    "n": 6.7, "o": 7.5, "p": 1.9, "q": 0.095, "r": 6.0, "s": 6.3, "t": 9.1, "u": 2.8, "v": 0.98, "w": 2.4, "x": 0.15, "y": 2.0, "z": 0.074,
}
VOWELS = "aeiou"
#: Chances in structured tokens: that a vowel follows a consonant or a vowel, that a letter is any of its
#: sort rather than one by frequency, and that a small letter, a capital, a digit or a separator is followed
#: by each of these.
AFTER_CONSONANT, AFTER_VOWEL, ANY = 0.52, 0.2, 0.2
FOLLOWS = ((0.86, 0.06, 0.05, 0.03), (0.7, 0.2, 0.05, 0.05), (0.12, 0.08, 0.75, 0.05), (0.45, 0.25, 0.25, 0.05), (0.25, 0.25, 0.25, 0.25))
_CHUNK = 256


def let(value: Column, body) -> Column:
    """``body`` of ``value`` with ``value`` evaluated, and written in the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column) -> Column:
    """[0, v0, v0 + v1, ...]: one longer than ``values``."""
    return F.aggregate(values, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def running_sums(values: Column) -> Column:
    """Exclusive running sums, in chunks so that long arrays aren't copied at every step."""
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(_CHUNK)), lambda i: F.slice(values, i + 1, _CHUNK))
    sums = lambda cs: _running(F.transform(cs, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)))
    within = lambda cs, shifts: F.transform(cs, lambda c, i: F.transform(F.slice(_running(c), 1, F.size(c)), lambda x: x + F.get(shifts, i)))
    return F.flatten(let(chunks, lambda cs: let(sums(cs), lambda shifts: within(cs, shifts))))


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of all matches, left to right: the pieces between matches and the
    matches themselves alternate, so running lengths are positions."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = let(gaps, lambda g: F.transform(matches, lambda m, i: F.struct(F.length(F.get(g, i)).alias("gap"), F.length(m).alias("size"), m.alias("match"))))
    place = lambda p, b: F.struct((b + p["gap"]).alias("start"), (b + p["gap"] + p["size"]).alias("end"), p["match"].alias("match"))
    return let(pairs, lambda ps: F.zip_with(ps, let(F.transform(ps, lambda p: p["gap"] + p["size"]), running_sums), place))


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _kind(found: Column, k: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"))).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds; cheap substring tests come before any pattern."""
    low = F.lower(text)
    named = F.lit(False)
    for n in NEEDLES:
        named = named | F.contains(low, F.lit(n))
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.zip_with(located(text, ASSIGN), values, lambda x, v: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.length(v).alias("n")))
    return F.concat(
        F.when(named, _kind(F.filter(assign, lambda x: x["n"] >= MIN_VALUE), 0)).otherwise(_none()),
        F.when(F.contains(text, F.lit("AKIA")), _kind(located(text, ACCESS), 1)).otherwise(_none()),
        F.when(text.rlike(HEX), _kind(located(text, HEX), 2)).otherwise(_none()),
    )


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal for z >= 0, by a rational approximation good to 1e-7."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


def _one_sided(z: Column) -> Column:
    return let(z, lambda z: F.greatest(F.when(z >= 0, _upper_tail(F.least(z, F.lit(37.0)))).otherwise(1 - _upper_tail(F.least(-z, F.lit(37.0)))), F.lit(1e-300)))


def _two_sided(z: Column) -> Column:
    return let(F.least(F.abs(z), F.lit(37.0)), lambda z: F.greatest(F.least(2 * _upper_tail(z), F.lit(1.0)), F.lit(1e-300)))


def battery(token: Column, alphabet: Column) -> Column:
    """Combined p-value of the four tests of ``token`` over ``alphabet``."""
    size = F.struct(F.length(token).cast("double").alias("n"), F.length(alphabet).cast("double").alias("k"))
    return let(size, lambda s: _combined(token, alphabet, s["n"], s["k"]))


def _combined(token: Column, alphabet: Column, n: Column, k: Column) -> Column:
    # length differences count a symbol in one pass over the token
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda a, c: a + F.pow((F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double"), F.lit(2.0)))
    chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    start = F.struct(*(F.lit(v).alias(c) for c, v in (("last", -1.0), ("first", 0.0), ("sum", 0.0), ("sq", 0.0), ("lag", 0.0), ("high", 0.0), ("runs", 0.0))))
    state = F.aggregate(F.split(token, ""), start, lambda a, c: let(F.call_function("instr", alphabet, c).cast("double") - 1, lambda v: _step(a, v, k)))

    def sequence(t: Column) -> Column:
        high, mean = t["high"], t["sum"] / n
        expected = 1 + 2 * high * (n - high) / n
        spread = let(expected, lambda e: F.sqrt(F.greatest((e - 1) * (e - 2) / (n - 1), F.lit(1e-9))))
        by_runs = F.when((high == 0) | (high == n), F.lit(37.0)).otherwise((t["runs"] - expected) / spread)
        var = F.greatest(t["sq"] / n - mean * mean, F.lit(1e-9))
        # circular lag product, so every symbol counts twice
        serial = ((t["lag"] + t["last"] * t["first"]) / n - mean * mean) / var
        halves = (2 * high - n) / F.sqrt(n)  # the root of chi-squared over two classes
        return -F.log(_two_sided(halves)) - F.log(_two_sided(by_runs)) - F.log(_two_sided((serial + 1 / (n - 1)) * F.sqrt(n)))

    return let(-F.log(_one_sided(chi)) + let(state, sequence), lambda x: F.exp(-x) * (1 + x + x * x / 2 + x * x * x / 6))


def _step(a: Column, v: Column, k: Column) -> Column:
    bits = F.struct((v * 2 >= k).alias("up"), (a["last"] * 2 >= k).alias("was"), (a["last"] < 0).alias("fresh"))
    return let(bits, lambda b: F.struct(
        v.alias("last"),
        F.when(b["fresh"], v).otherwise(a["first"]).alias("first"),
        (a["sum"] + v).alias("sum"),
        (a["sq"] + v * v).alias("sq"),
        F.when(b["fresh"], F.lit(0.0)).otherwise(a["lag"] + a["last"] * v).alias("lag"),
        (a["high"] + b["up"].cast("double")).alias("high"),
        (a["runs"] + (b["fresh"] | (b["up"] != b["was"])).cast("double")).alias("runs"),
    ))


_SYMBOLS = "+/_-"
_CHARACTERS = "".join(LETTERS) + "".join(LETTERS).upper() + "0123456789" + _SYMBOLS
_KINDS = 6  # small vowel, small consonant, capital vowel, capital consonant, digit, separator


def _word_model() -> tuple[list[int], list[float], list[float]]:
    """The kind and cost in bits of every character, and the costs of kinds that follow one another, row by
    row with one more for the beginning. The chances of a row add up to one."""
    sorts = {v: {c: f for c, f in LETTERS.items() if (c in VOWELS) == v} for v in (True, False)}
    chance = {c: (1 - ANY) * f / sum(sort.values()) + ANY / len(sort) for sort in sorts.values() for c, f in sort.items()}
    kinds, costs = [], []
    for c in _CHARACTERS:
        low = c.lower()
        kinds.append((low not in VOWELS) + 2 * (c != low) if low in LETTERS else 4 + (c in _SYMBOLS))
        costs.append(-math.log2(chance[low]) if low in LETTERS else math.log2(10 if c.isdigit() else len(_SYMBOLS)))
    group, turns = (0, 0, 1, 1, 2, 3, 4), []
    for kind in range(_KINDS + 1):
        vowel = AFTER_VOWEL if kind in (0, 2) else AFTER_CONSONANT
        for to in range(_KINDS):
            turns.append(-math.log2(FOLLOWS[group[kind]][group[to]] * (1 if to >= 4 else vowel if to % 2 == 0 else 1 - vowel)))
    return kinds, costs, turns


_CHARACTER_KINDS, _COSTS, _TURNS = _word_model()
#: The same turns within tokens of one kind alone, which make up half of the model: vowels and consonants only.
_TURNS_ALONE = [
    0.0 if to >= 4 else -math.log2(v if to % 2 == 0 else 1 - v)
    for kind in range(_KINDS + 1) for to in range(_KINDS) for v in [AFTER_VOWEL if kind in (0, 2) else AFTER_CONSONANT]
]


def evidence(token: Column, alphabet: Column) -> Column:
    """Bits by which uniform choice from ``alphabet`` explains the token better than words do."""
    array = lambda values: F.array(*map(F.lit, values))
    tables = F.struct(array(_CHARACTER_KINDS).alias("kinds"), array(_COSTS).alias("costs"), array(_TURNS).alias("turns"), array(_TURNS_ALONE).alias("alone"))
    start = F.struct(F.lit(_KINDS).alias("last"), F.lit(0.0).alias("mixed"), F.lit(0.0).alias("single"))

    def step(a: Column, c: Column, t: Column) -> Column:
        at = F.call_function("instr", F.lit(_CHARACTERS), c) - 1
        known = F.struct(F.get(t["kinds"], at).alias("kind"), F.get(t["costs"], at).alias("cost"))
        turn = lambda x: a["last"] * _KINDS + x["kind"]
        return let(known, lambda x: F.struct(x["kind"].alias("last"), (a["mixed"] + x["cost"] + F.get(t["turns"], turn(x))).alias("mixed"), (a["single"] + x["cost"] + F.get(t["alone"], turn(x))).alias("single")))

    one_kind = token.rlike("^(?:[a-z]*|[A-Z]*|[0-9]*)$")
    cost = let(tables, lambda t: F.aggregate(F.split(token, ""), start, lambda a, c: step(a, c, t), lambda a: 1 + F.when(one_kind, F.least(a["mixed"], a["single"])).otherwise(a["mixed"])))
    return cost - F.length(token) * F.log2(F.length(alphabet).cast("double"))


def candidates(text: Column, max_false: float = MAX_FALSE) -> Column:
    """Array of (start, end, class, token, level): class holds the encoding and the length class, level the
    whole bits of evidence, 0 where the battery finds structure."""
    whole = lambda found: F.filter(found, lambda x: F.length(x["match"]) >= MIN_TOKEN)

    def split(x: Column) -> Column:
        shift = lambda y: F.struct((x["start"] + y["start"]).alias("start"), (x["start"] + y["end"]).alias("end"), y["match"].alias("match"))
        mixed = x["match"].rlike("[+/]") & x["match"].rlike("[_-]")
        return F.when(mixed, F.concat(*(F.transform(whole(located(x["match"], p)), shift) for p in PIECES))).otherwise(F.array(x))

    found = F.array_distinct(F.flatten(F.transform(whole(located(text, TOKEN)), split)))
    bare = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.rtrim(x["match"], F.lit("=")).alias("token")))
    least = -math.log2(max_false)

    def level(token: Column, letters: Column) -> Column:
        """The battery looks at tokens only that have the evidence to be found at all."""
        bits = F.least(F.floor(evidence(token, letters)).cast("int"), F.lit(LEVELS))
        return let(bits, lambda b: F.when(b < least, F.lit(0)).when(battery(token, letters) < MIN_RANDOM, F.lit(0)).otherwise(b))

    def judged(x: Column) -> Column:
        code, letters = F.lit(None).cast("int"), F.array(*(F.lit(e[1]) for e in ENCODINGS))
        for i, (_, _, pattern) in reversed(list(enumerate(ENCODINGS))):
            code = F.when(x["token"].rlike(pattern), F.lit(i)).otherwise(code)
        size = F.least(F.floor(F.log2(F.length(x["token"]).cast("double"))).cast("int"), F.lit(15))
        return let(code, lambda c: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), (c * 16 + size).alias("class"), F.xxhash64(x["token"]).alias("token"),
            F.when(c.isNotNull() & (F.length(x["token"]) > 2), let(F.get(letters, c), lambda a: level(x["token"], a))).alias("level"),
        ))

    return F.filter(F.transform(bare, judged), lambda x: x["level"].isNotNull())


def cuts(scanned: DataFrame, max_false: float) -> DataFrame:
    """One row: a map from class to the lowest level that is kept, of the classes that have one. At most 16
    classes per encoding and LEVELS levels take part, whatever the corpus."""
    tokens = scanned.select(F.explode("found").alias("x")).select("x.class", "x.token", "x.level").distinct()
    counts = tokens.groupBy("class", "level").agg(F.count("*").alias("n"))
    above = Window.partitionBy("class").orderBy(F.desc("level"))
    all_of = F.sum("n").over(Window.partitionBy("class"))
    steps = counts.select("class", "level", (all_of * F.pow(F.lit(2.0), -F.col("level")) <= max_false * F.sum("n").over(above)).alias("fits"))
    classes = steps.where(F.col("fits") & (F.col("level") > 0)).groupBy("class").agg(F.min("level").alias("cut"))
    return classes.agg(F.map_from_entries(F.collect_list(F.struct("class", "cut"))).alias("cuts"))


def _names(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, "random")))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets(spark: SparkSession, docs: DataFrame, max_false: float = MAX_FALSE) -> DataFrame:
    """Counts and digest of the fixed kinds and all spans, per document row. Random tokens that overlap
    a fixed span or lie inside another random one are dropped; fixed spans always stay."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id",
        base_spans(F.col("text")).alias("base"),
        F.when(F.col("text").rlike(TOKEN), candidates(F.col("text"), max_false)).otherwise(F.array().cast("array<struct<start:int,end:int,class:int,token:bigint,level:int>>")).alias("found"),
    )
    scanned = materialize(spark, scanned, "secrets")
    cut = cuts(scanned.where("size(found) > 0"), max_false).scalar()
    base = F.col("base")
    random = F.filter(F.col("found"), lambda x: (x["level"] >= F.try_element_at(F.col("cuts"), x["class"])) & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    inside = lambda x, y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & (y["end"] - y["start"] > x["end"] - x["start"])
    extra = let(random, lambda xs: F.filter(xs, lambda x: ~F.exists(xs, lambda y: inside(x, y))))
    every = F.concat(base, _kind(extra, 3))
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long")
    return scanned.withColumn("cuts", F.when(F.size("found") > 0, cut)).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_names(base), 256).alias("base_sha256"), _names(every).alias("spans"), F.size(every).cast("long").alias("n_secrets"),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
