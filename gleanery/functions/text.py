"""Text expressions: tokens, names, brands, weights and agreement of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.config import BRAND_STOPWORDS, GARBAGE_NAMES, NOT_FOOD_TOKENS

_UNIT = r"(g|gr|kg|ml|cl|l|oz|lb)"


def normalised(s: Column) -> Column:
    """Lower case, with runs of anything but letters, digits and underscores as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def tokens(s: Column) -> Column:
    """The distinct words of over three characters; none for null."""
    return F.filter(F.array_distinct(F.split(normalised(F.coalesce(s, F.lit(""))), " ")), lambda t: F.length(t) > 3)


def name_ratio(anchor: Column, text: Column) -> Column:
    """The share of the anchor's tokens that stand anywhere in the text; 0 without tokens."""
    t, low = tokens(anchor), F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.size(t) > 0, F.size(F.filter(t, lambda x: F.contains(low, x))) / F.size(t)).otherwise(0.0)


def word_ratio(anchor: Column, text: Column) -> Column:
    """name_ratio over the words between blanks as they are, punctuation included."""
    t, low = F.filter(F.array_distinct(F.split(F.lower(F.coalesce(anchor, F.lit(""))), r"\s+")), lambda x: F.length(x) > 3), F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.size(t) > 0, F.size(F.filter(t, lambda x: F.contains(low, x))) / F.size(t)).otherwise(0.0)


def best_ratio(anchors: Column, text: Column) -> Column:
    """The best ratio of several anchors; 0 without any."""
    named = F.filter(anchors, lambda a: a.isNotNull() & (a != ""))
    return F.coalesce(F.array_max(F.transform(named, lambda a: name_ratio(a, text))), F.lit(0.0))


def relevant(ground_truth: Column, title: Column, snippet: Column, least: float = 0.3) -> Column:
    """Whether a search result's text has enough of the wanted name; any has where nothing is wanted."""
    both = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")))
    return (F.size(tokens(ground_truth)) == 0) | (name_ratio(ground_truth, both) >= least)


def without_packs(s: Column) -> Column:
    """The text without "(6 pack)" and "(pack of 6)", and with "6 x 330 ml" as "330 ml"."""
    s = F.regexp_replace(s, r"\(\s*[0-9]+\s*[Pp]ack[^)]*\)", "")
    s = F.regexp_replace(s, r"\(\s*[Pp]ack\s+of\s+[0-9]+[^)]*\)", "")
    s = F.regexp_replace(s, rf"(?i)\b[0-9]+\s*[x×]\s*([0-9]+(?:[.,][0-9]+)?\s*{_UNIT})\b", "$1")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r",\s*,", ","), r"\s{2,}", " "))
    return F.trim(F.regexp_replace(s, r"^,+|,+$", ""))


def weight(s: Column) -> Column:
    """The unit size in a text, "330ml": of a pack notation first, else the first size; null without one."""

    def read(pattern: str) -> Column:
        found = F.concat(F.regexp_extract(s, pattern, 1), F.lower(F.regexp_extract(s, pattern, 2)))
        return F.nullif(found, F.lit(""))

    return F.coalesce(read(rf"(?i)\b[0-9]+\s*[x×]\s*([0-9]+(?:[.,][0-9]+)?)\s*{_UNIT}\b"), read(rf"(?i)\b([0-9]+(?:[.,][0-9]+)?)\s*{_UNIT}\b"))


def weights_conflict(anchors: Column, text: Column) -> Column:
    """Whether the text tells a size and some anchor tells it otherwise."""
    own = weight(text)
    return F.coalesce(F.exists(anchors, lambda a: weight(a) != own), F.lit(False)) & own.isNotNull()


def brand(s: Column) -> Column:
    """The first word that can be a brand: three characters or more, a capital first, no stop word and no number."""
    bare = F.transform(F.split(F.trim(s), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:()/-]+|[.,;:()/-]+$", ""))

    def fits(w: Column) -> Column:
        return (F.length(w) >= 3) & w.rlike(r"^\p{Lu}") & ~F.lower(w).isin(*BRAND_STOPWORDS) & ~F.replace(w, F.lit("."), F.lit("")).rlike("^[0-9]+$")

    return F.get(F.filter(bare, fits), 0)


def brand_in_host(brand_: Column, host: Column) -> Column:
    """Whether the brand, four characters or more, stands in the host."""
    b, h = F.regexp_replace(F.lower(brand_), "[^a-z0-9]", ""), F.regexp_replace(F.lower(host), "[^a-z0-9.]", "")
    return F.coalesce((F.length(b) >= 4) & F.contains(h, b), F.lit(False))


def name_from_title(title: Column) -> Column:
    """What stands before the first hyphen and the first bar."""
    return F.trim(F.split_part(F.split_part(title, F.lit("-"), F.lit(1)), F.lit("|"), F.lit(1)))


def garbage_name(s: Column) -> Column:
    """Whether a name is too short, a URL, or of a kind that registries give for nothing."""
    t = F.lower(F.trim(F.coalesce(s, F.lit(""))))
    return (F.length(t) < 3) | t.startswith("http") | t.startswith("www.") | t.rlike("|".join(f"(?:{p})" for p in GARBAGE_NAMES))


def food_title(s: Column) -> Column:
    """Whether a title has no word that speaks against food; so has a missing one."""
    low = F.lower(F.coalesce(s, F.lit("")))
    out = F.lit(True)
    for t in NOT_FOOD_TOKENS:
        out = out & ~F.contains(low, F.lit(t))
    return out


def numbers_agree(a: Column, b: Column) -> Column:
    """Whether two numbers differ by at most 0.5 or 3 % of the larger."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(0.5), 0.03 * F.greatest(F.abs(a), F.abs(b))), F.lit(False))


def texts_agree(a: Column, b: Column, least: float = 0.8) -> Column:
    """Whether two texts are the same when normalised, or share enough of the larger one's tokens."""
    ta, tb = tokens(a), tokens(b)
    most = F.greatest(F.size(ta), F.size(tb))
    shared = F.when((F.size(ta) > 0) & (F.size(tb) > 0), F.size(F.array_intersect(ta, tb)) / most >= least).otherwise(False)
    return F.coalesce(((normalised(a) == normalised(b)) | shared) & (a != "") & (b != ""), F.lit(False))


def sanitised(c: Column) -> Column:
    """Missing values and the words for them as an empty text."""
    return F.when(c.isNull() | c.isin("null", "None"), "").otherwise(c)


def search_clause(*clauses: Column) -> Column:
    """Search clauses joined by OR, empty ones left out, for whoever fetches results."""
    return F.concat_ws(" OR ", *(F.nullif(F.trim(F.regexp_replace(c, r"^(\s|OR\b)+|(\s|\bOR)+$", "")), F.lit("")) for c in clauses))
