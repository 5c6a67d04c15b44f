"""Text and hashing functions as Column expressions (code-point semantics, Unicode whitespace)."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters dropped by the two normal forms.
PUNCTUATION = "，。！？、；：「」『』（）《》…—\\-,.!?;:\"'~·"
ASR_PUNCTUATION = "，。！？、；：「」『』（）…—,.!?;:\"'"

#: Java's \s is ASCII unless (?U) is set, and then still lacks the four separators 0x1c-0x1f.
_SPACE = "\\s\\x1c-\\x1f"
#: The same class as characters, for translate(): the white space of Unicode and the four separators.
_BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_NORM = f"(?U)[{_SPACE}{PUNCTUATION}]"
_ASR_NORM = f"(?U)[{_SPACE}{ASR_PUNCTUATION}]"
_EDGE = f"(?U)^[{_SPACE}]+|[{_SPACE}]+$"


def blank(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def strip(value: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.regexp_replace(value, _EDGE, "")


def norm_text(text: Column) -> Column:
    """The comparison form: no whitespace, no punctuation; null becomes empty."""
    return F.translate(blank(text), _BLANKS + PUNCTUATION.replace("\\", ""), "")


def asr_norm(text: Column) -> Column:
    """Without <|tags|>, other symbols, whitespace and the narrower punctuation class."""
    plain = F.translate(bare := without_tags(blank(text)), _BLANKS + ASR_PUNCTUATION, "")
    # the kept symbols are beyond ASCII, so texts of one byte a character have none
    return F.when(F.length(bare) == F.octet_length(bare), plain).otherwise(F.regexp_replace(plain, "\\p{So}", ""))


def without_tags(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<|")), F.regexp_replace(text, "<\\|[^|]+\\|>", "")).otherwise(text)


#: The form of character ids and of ratings file names.
_ID = "^[a-z0-9_]+$"
_RATINGS_NAME = "(?U)^listen-ratings[\\w-]*\\.json\\z"


def valid_id(value: Column) -> Column:
    return F.coalesce(F.regexp_like(value, F.lit(_ID)), F.lit(False))


def valid_ratings_name(value: Column) -> Column:
    return F.coalesce(F.regexp_like(value, F.lit(_RATINGS_NAME)), F.lit(False))


def is_json_object(value: Column) -> Column:
    """Whether a text is one JSON object; lists, scalars, broken and empty texts are not."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT"), F.lit(False))


def content_sha(value: Column) -> Column:
    return F.sha2(value, 256)


def text_fid(text: Column, audio_sha: Column) -> Column:
    """Stable utterance id over the normal form and the audio hash."""
    return F.sha2(F.concat(norm_text(text), F.lit("|"), audio_sha), 256)


def split_fraction(fid: Column) -> Column:
    """Uniform position of an id in [0, 1], from 32 bits of a salted hash."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit("split|"), fid), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def split_bucket(fid: Column, val_frac: float = 0.1, test_frac: float = 0.1) -> Column:
    h = split_fraction(fid)
    return F.when(h < test_frac, "test").when(h < test_frac + val_frac, "validation").otherwise("train")


def path_parts(path: Column) -> dict[str, Column]:
    """Slash-normalised path, parent directory, file name, stem and lower-case suffix."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.element_at(F.split(clean, "/"), -1)
    return {
        "path": clean,
        "parent": F.try_element_at(F.split(clean, "/"), F.lit(-2)),
        "name": name,
        "stem": F.regexp_replace(name, "(?<=.)\\.[^.]*$", ""),
        "suffix": F.lower(F.regexp_extract(name, "(?<=.)(\\.[^.]*)$", 1)),
    }


def parse_inbox_name(path: Column) -> Column:
    """struct(label, text) from a file name: a bracketed label wins over the parent directory, except
    where nothing follows it; purely numbered texts are empty."""
    p = path_parts(path)
    parent = F.when(p["parent"] != "inbox", p["parent"])
    full = F.regexp_extract(p["stem"], "^【([^】]+)】(.+)$", 1)
    alone = F.regexp_extract(p["stem"], f"(?U)^【([^】]+)】[{_SPACE}]*$", 1)
    body = strip(F.when(full != "", F.regexp_extract(p["stem"], "^【([^】]+)】(.+)$", 2)).otherwise(p["stem"]))
    text = F.when((full == "") & (alone != ""), "").when(F.regexp_like(body, F.lit("(?U)^[_\\-\\d]+$")), "").otherwise(body)
    label = F.when(full != "", full).when(alone != "", F.coalesce(parent, alone)).otherwise(parent)
    return F.struct(label.alias("label"), text.alias("text"))


def cer(reference: Column, hypothesis: Column) -> Column:
    """struct(cer, distance, n): Levenshtein distance over the reference length; an empty reference
    gives (0, 0, 0) against nothing and (1, 0, len) against something."""
    n, h = F.length(reference), F.length(hypothesis)
    d = F.levenshtein(reference, hypothesis)
    return F.struct(
        F.when((n == 0) & (h == 0), 0.0).when(n == 0, 1.0).otherwise(d / F.greatest(n, F.lit(1))).alias("cer"),
        F.when(n == 0, 0).otherwise(d).alias("distance"),
        F.when(n == 0, h).otherwise(n).alias("n"),
    )


def split_sentences(text: Column, max_chars: int, hard_cut: bool = True, keep_blank: bool = True) -> Column:
    """Greedy packing of sentences into chunks of at most ``max_chars``: long sentences fall back to
    clauses and, with ``hard_cut``, longer clauses are cut; the open chunk is closed before a cut."""
    def pieces(value: Column, pattern: str) -> Column:
        return F.filter(F.transform(F.split(value, pattern, -1), strip), lambda s: s != "")

    sentences = pieces(text, "(?<=[。！？!?；;…])")
    clauses = F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) > max_chars, pieces(s, "(?<=[，,、：:])")).otherwise(F.array(s))))
    empty = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        cuts = F.when(F.lit(hard_cut) & (F.length(s) > max_chars), F.floor((F.length(s) - 1) / max_chars).cast("int")).otherwise(0)
        heads = F.when(cuts > 0, F.transform(F.sequence(F.lit(0), F.greatest(cuts - 1, F.lit(0))), lambda i: F.substr(s, i * max_chars + 1, F.lit(max_chars)))).otherwise(empty)
        rest = F.substr(s, cuts * max_chars + 1)
        closing = (acc["cur"] != "") & ((cuts > 0) | (F.length(acc["cur"]) + F.length(rest) > max_chars))
        done = F.concat(acc["done"], F.when(closing, F.array(acc["cur"])).otherwise(empty), heads)
        return F.struct(done.alias("done"), F.concat(F.when(closing, "").otherwise(acc["cur"]), rest).alias("cur"))

    packed = F.aggregate(clauses, F.struct(empty.alias("done"), F.lit("").alias("cur")), step)
    chunks = F.transform(F.array(packed), lambda p: F.concat(p["done"], F.when(p["cur"] != "", F.array(p["cur"])).otherwise(empty)))[0]
    return F.when(F.size(chunks) > 0, chunks).otherwise(F.array(text)) if keep_blank else chunks


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)[{_SPACE}]+", " ")


def expand_env(text: Column, env: dict[str, str]) -> Column:
    """${NAME} and ${NAME:default}; an unknown name without default raises."""
    table = F.create_map(*(F.lit(x) for kv in env.items() for x in kv)) if env else F.create_map().cast("map<string,string>")
    names = F.regexp_extract_all(text, F.lit("\\$\\{([A-Za-z_][A-Za-z0-9_]*)(?::[^}]*)?\\}"), F.lit(0))

    def one(acc: Column, token: Column) -> Column:
        name = F.regexp_extract(token, "^\\$\\{([A-Za-z_][A-Za-z0-9_]*)", 1)
        default = F.when(F.contains(token, F.lit(":")), F.regexp_extract(token, ":([^}]*)\\}$", 1))
        value = F.coalesce(F.try_element_at(table, name), default)
        return F.replace(acc, token, F.coalesce(value, F.raise_error(F.concat(F.lit("unknown variable "), name)).cast("string")))

    return F.aggregate(names, text, one)


def count_of(text: Column, needle: str) -> Column:
    """Occurrences of a literal."""
    return F.regexp_count(text, F.lit("\\Q" + needle + "\\E"))


def prefix(value: Column, delimiter: str) -> Column:
    return F.substring_index(value, delimiter, 1)


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings; not symmetric, so the argument order matters."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """An upper bound of ``fuzzy_ratio`` from the lengths alone."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb > 0, 2.0 * F.least(la, lb) / (la + lb)).otherwise(1.0)


def register(spark) -> None:
    """Make the scalar functions callable from SQL text."""
    spark.udf.register("fuzzy_ratio", fuzzy_ratio)
    norm, asr = _NORM.replace("\\", "\\\\").replace("'", "\\'"), _ASR_NORM.replace("\\", "\\\\").replace("'", "\\'")
    for name, args, body in (
        ("norm_text", "t STRING", f"regexp_replace(coalesce(t, ''), '{norm}', '')"),
        ("asr_norm", "t STRING", f"regexp_replace(regexp_replace(regexp_replace(coalesce(t, ''), '<\\\\|[^|]+\\\\|>', ''), '\\\\p{{So}}', ''), '{asr}', '')"),
        ("split_fraction", "f STRING", "cast(conv(substr(sha2('split|' || f, 256), 1, 8), 16, 10) as double) / 4294967295.0D"),
    ):
        kind = "DOUBLE" if name == "split_fraction" else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
