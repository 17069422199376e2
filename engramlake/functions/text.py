"""Text expressions: tags, words, keywords, sentences, languages and triviality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short stop-word lists by ISO 639-3 code.
STOPWORDS = {
    "eng": "a about after all also an and any are as at be because been but by can could did do does for from had has have he her his how i if in into is it its just me more my no not of on or our out over she should so some than that the their them then there these they this to up us was we were what when where which who why will with would you your".split(),
    "fra": "au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui ma mais me mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous".split(),
    "deu": "aber als am an auch auf aus bei bin bis da das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im in ist ja mit nach nicht noch nur oder sein sich sie sind so und uns von vor war was wenn wie wir zu zum zur".split(),
    "spa": "al algo como con de del desde donde el ella en entre es esta este ha hay la las le lo los me mi muy más no nos o para pero por que qué se si sin sobre son su sus también te tu un una y ya yo".split(),
}
# ISO 639-3 to 639-1.
ISO1 = {"eng": "en", "fra": "fr", "deu": "de", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "rus": "ru", "jpn": "ja", "zho": "zh", "kor": "ko"}

WORD = r"[\p{L}\p{N}]+"


def parse_tags(tags: Column) -> Column:
    """Comma-separated tags, trimmed; empty ones are kept, null or '' gives none."""
    return F.when(F.coalesce(tags, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(tags, ","), lambda x: F.trim(x))
    )


def normal_tags(tags: Column) -> Column:
    """Tags trimmed and lower-cased without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def keywords(text: Column, lang: str = "eng") -> Column:
    """Words of more than one letter that are no stop words; repeats are kept."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS.get(lang, STOPWORDS["eng"])])
    return F.filter(words(text), lambda w: ~F.array_contains(stop, w) & (F.length(w) > 1))


def sentences(text: Column) -> Column:
    """Sentences, cut after ., ! or ? and blanks; trimmed, empty ones dropped."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def locale(code: Column) -> Column:
    """ISO 639-1 code of an ISO 639-3 code; en for unknown ones."""
    table = F.create_map(*[F.lit(x) for kv in ISO1.items() for x in kv])
    return F.coalesce(table[code], F.lit("en"))


def detect_language(text: Column, default: str = "eng", configured: str | None = None, least: int = 20) -> Column:
    """ISO 639-3 code of the language whose stop words are most frequent; the default for short or undecided texts."""
    if configured:
        return F.lit(configured)
    w = words(text)


    def count(code: str) -> Column:
        stop = F.array(*[F.lit(s) for s in STOPWORDS[code]])
        return F.size(F.filter(w, lambda x: F.array_contains(stop, x)))

    hits = {c: count(c) for c in STOPWORDS}
    best = F.greatest(*hits.values())
    pick = F.coalesce(*[F.when(hits[c] == best, F.lit(c)) for c in STOPWORDS])
    return F.when((F.length(F.coalesce(text, F.lit(""))) < least) | (best == 0), F.lit(default)).otherwise(pick)


def is_trivial(content: Column, least: int = 15) -> Column:
    """A question, or shorter than `least` characters, after trimming; null is trivial."""
    t = F.trim(F.coalesce(content, F.lit("")))
    return t.endswith("?") | (F.length(t) < least)


def metadata_value(metadata: Column, key: str) -> Column:
    """A value of the JSON metadata, null where it is missing or the JSON is cut off."""
    return F.when(F.try_parse_json(metadata).isNotNull(), F.get_json_object(metadata, f"$.{key}"))


def numbered(contents: Column) -> Column:
    """'[1] text' blocks, separated by blank lines."""
    return F.array_join(F.transform(contents, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n\n")
