"""Text normalisation and string features as column expressions: all of it runs in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_PUNCTUATION = "[!-/:-@\\[-`{-~]"
#: The punctuation that is removed from Chinese text besides the ASCII one.
CJK_PUNCTUATION = "！？｡。·＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏."
NUMBER = "dddddd"


def _numbers(c: Column, digits: str) -> Column:
    """Each number that stands alone becomes NUMBER; first those after a space, then one at the start."""
    for before in ("(?<=\\s)", "(?<=^)"):
        c = F.regexp_replace(c, f"(?U){before}{digits}(?=($|\\s))", NUMBER)
    return c


def regularize(c: Column, lang: str = "en") -> Column:
    """Without punctuation, white space collapsed, runs of numbers as one NUMBER, lower case, trimmed.
    A blank string becomes NUMBER, as runs of white space count as numbers at the start."""
    c = F.regexp_replace(c, ASCII_PUNCTUATION, "")
    if lang == "zh":
        c = F.translate(c, CJK_PUNCTUATION, "")
    return F.trim(F.lower(_numbers(F.regexp_replace(c, "(?U)\\s+", " "), "[\\d\\s]+")))


def maprule(c: Column) -> Column:
    """As regularize, but punctuation becomes a space and each number counts alone."""
    c = F.regexp_replace(F.regexp_replace(c, ASCII_PUNCTUATION, " "), "(?U)\\s+", " ")
    return F.trim(F.lower(_numbers(c, "\\d+")))


def long_enough(c: Column, least: int = 11) -> Column:
    return F.length(c) > least


def simplified(c: Column) -> Column:
    """-{zh-hans:X; ...}- or -{zh-cn:X}- becomes X."""
    return F.regexp_replace(c, "-\\{.*?(?:zh-hans|zh-cn):([^;]*?)(?:;.*?\\}|\\})-", "$1")


def without_suffix(label: Column) -> Column:
    """A label without the bracketed suffix that tells it apart."""
    return F.trim(F.regexp_replace(label, "\\(.*?\\)$", ""))


def mention_length(label: Column) -> Column:
    return F.size(F.split(without_suffix(label), " "))


def plain_text(c: Column) -> Column:
    """[[target|label]] and [[label]] become label, {{mention}} becomes mention."""
    c = F.regexp_replace(c, "\\[\\[(?:[^|\\]]*\\|)?([^\\]]*)\\]\\]", "$1")
    return F.regexp_replace(c, "\\{\\{([^}]*)\\}\\}", "$1")


def upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2147483647))


def lower_first(c: Column) -> Column:
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 2147483647))


def normal_title(c: Column) -> Column:
    """Underscores and spaces at the ends go, runs of them become one space, the first letter is upper case."""
    return upper_first(F.trim(F.regexp_replace(F.trim(F.translate(c, "_", " ")), "[ _]+", " ")))


def unescape(c: Column) -> Column:
    """The five entities of XML and the space that doesn't break; html.unescape in markup.py knows all."""
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / the longer length; two empty strings are alike."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def string_features(mention: Column, label: Column) -> list[Column]:
    """Equality, "not a prefix" (1 where the mention is elsewhere in the label or absent from it), prefix, suffix, containment."""
    m, e = F.lower(mention), F.lower(label)
    bit = lambda c: c.cast("int")
    return [
        bit(m == e).alias("same"),
        bit(F.instr(e, m) != 1).alias("not_prefix"),
        bit(F.startswith(e, m)).alias("prefix"),
        bit(F.endswith(e, m)).alias("suffix"),
        bit(F.contains(e, m)).alias("contains"),
    ]
