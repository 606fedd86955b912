"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that searches ignore.
STOPWORDS = """
的 了 和 是 在 我 有 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这
那 他 她 它 们 我们 你们 他们 与 及 或 而 但 并 对 从 被 把 给 让 使 于 中 内 外 前 后 里
什么 怎么 如何 为什么 哪些 哪个 可以 能够 需要 应该 可能 已经 还是 因为 所以 如果 虽然 但是
以及 并且 而且 然后 因此 例如 比如 等等 一些 这些 那些 这个 那个 之 其 该 等 按 按照
a an the of to in is are was were be been being for on with as by at from that this these those
and or not it its it's if then than so such can could should would may might will just do does did
""".split()

CJK = "一-鿿㐀-䶿"
WORD = rf"[{CJK}]+|[a-z][a-z0-9_\-']*|[0-9]+(?:\.[0-9]+)?"


def tokens(text: Column, keep_stopwords: bool = False) -> Column:
    """Lower-case words and numbers; a run of ideographs gives its characters, then its pairs of neighbours."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))

    def expand(x: Column) -> Column:
        chars = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substr(x, i, F.lit(1)))
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substr(x, i, F.lit(2)))
        pairs = F.when(F.length(x) > 1, pairs).otherwise(F.array().cast("array<string>"))
        return F.when(x.rlike(f"^[{CJK}]"), F.concat(chars, pairs)).otherwise(F.array(x))

    found = F.when(F.lower(text).rlike(f"[{CJK}]"), F.flatten(F.transform(found, expand))).otherwise(found)
    return found if keep_stopwords else F.filter(found, lambda x: ~x.isin(STOPWORDS))


def squash_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \t 　]+", " "))


def contains_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK}]")


def char_ngrams(text: Column, least: int = 1, most: int = 3) -> Column:
    low = F.lower(F.regexp_replace(text, "[ \t 　]+", " "))

    chars = F.split(low, "")

    def of(n: int) -> Column:
        grams = chars
        for k in range(1, n):
            grams = F.zip_with(grams, F.slice(chars, k + 1, F.greatest(F.size(chars) - k, F.lit(0))), lambda x, y: F.concat(x, y))
        return F.when(F.length(low) >= n, F.slice(grams, 1, F.greatest(F.size(chars) - n + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(least, most + 1)])


SENTENCE = "[^。！？!?…；;\n]*(?:[。！？!?…；;\n][”’」』）)\\]\"']*|$)"


def sentences(text: Column) -> Column:
    """Sentences end at CJK or ASCII terminators other than the full stop, or at a line break, with closing marks after it; trimmed, not empty."""
    found = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(found, lambda x: F.length(x) > 0)


def estimate_tokens(text: Column) -> Column:
    cjk = F.length(F.regexp_replace(text, f"[^{CJK}]+", ""))
    return F.when(F.length(text) == 0, 0).otherwise(F.floor(cjk + F.lit(0.3) * (F.length(text) - cjk)) + 1).cast("int")


def truncate(text: Column, most: int, suffix: str = "…") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(suffix)), F.lit(suffix))).otherwise(text)


def hex_to_long(digits: Column) -> Column:
    """16 hex digits as a signed 64-bit number with the same bits."""
    return F.conv(digits, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def char_overlap(a: Column, b: Column) -> Column:
    own = F.array_distinct(F.split(a, ""))
    return F.when((a == "") | (b == ""), 0.0).otherwise(F.size(F.array_intersect(own, F.split(b, ""))) / F.size(own))
