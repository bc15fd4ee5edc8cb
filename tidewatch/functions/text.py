"""Text expressions: white space, hashes, tokens, keywords, entities and query decomposition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space; plain \s in Java misses the no-break space and its kin.
SPACE_RE = r"(?U)\s+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIN_TEXT, MAX_TEXT = 3, 700
MAX_KEYWORDS, MAX_ENTITIES, MIN_KEYWORD = 24, 12, 3
WEIGHTS = {"query": 1.2, "keyword": 0.6, "entity": 0.9}

# Words that are never keywords.
STOPWORDS = (
    "about after again against alert also among and are because been before being between could email find for from "
    "have into just more notify should that the their them then there these they this those through tools when where "
    "which while with would"
).split()
# Verbs that begin an instruction and so no entity.
INSTRUCTIONS = "alert email find let notify show tell track watch".split()

_NOT_WORD = r"[^\p{IsAlphabetic}\p{N}_-]+"


def collapse_whitespace(c: Column) -> Column:
    """Runs of white space become one blank; none at either end."""
    return F.trim(F.regexp_replace(c, SPACE_RE, " "))


def content_sha256(c: Column) -> Column:
    """Hash of a content that white space does not change."""
    return F.sha2(collapse_whitespace(c).cast("binary"), 256)


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(c, UPPER, LOWER)


def tokens(c: Column) -> Column:
    """White-space tokens without punctuation at either end; hyphens and underscores stay."""
    bare = F.transform(
        F.split(collapse_whitespace(c), " "), lambda w: F.regexp_replace(w, f"^{_NOT_WORD}|{_NOT_WORD}$", "")
    )
    return F.filter(bare, lambda w: w != "")


def keywords(c: Column) -> Column:
    """Distinct lower-case tokens in order of first occurrence, without short ones and stopwords."""
    low = F.transform(tokens(c), ascii_lower)
    kept = F.filter(low, lambda w: (F.char_length(w) >= MIN_KEYWORD) & ~w.isin(STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, MAX_KEYWORDS)


def entities(c: Column) -> Column:
    """Runs of capitalised words, distinct but for ASCII case, in order.

    A word counts if its first character is upper case and a later one lower
    case; an instruction verb in first place does not. Punctuation does not end a run.
    """

    def part(word: Column, i: Column) -> Column:
        capital = word.rlike(r"(?s)^\p{IsUppercase}.*\p{IsLowercase}")
        verb = (i == 0) & ascii_lower(word).isin(INSTRUCTIONS)
        return F.when(capital & ~verb, word).otherwise("\n")

    # Words that end a run become a separator, which no token holds.
    runs = F.split(F.array_join(F.transform(tokens(c), part), " "), "\n")
    runs = F.filter(F.transform(runs, lambda r: F.trim(r)), lambda r: r != "")
    none = F.array().cast("array<string>")

    def add(state: Column, run: Column) -> Column:
        again = F.array_contains(state["seen"], ascii_lower(run)) | (F.size(state["out"]) >= MAX_ENTITIES)
        seen = F.when(again, state["seen"]).otherwise(F.concat(state["seen"], F.array(ascii_lower(run))))
        out = F.when(again, state["out"]).otherwise(F.concat(state["out"], F.array(run)))
        return F.struct(seen.alias("seen"), out.alias("out"))

    return F.aggregate(runs, F.struct(none.alias("seen"), none.alias("out")), add)["out"]


def valid_text(c: Column) -> Column:
    return F.coalesce(F.char_length(collapse_whitespace(c)).between(MIN_TEXT, MAX_TEXT), F.lit(False))


def query_inputs(c: Column) -> Column:
    """Weighted embedding inputs of a query: the whole text, its keywords, its entities.

    An array of (kind, text, weight) whose places are the ordinals; null for a
    text that is too short or too long.
    """

    def tagged(kind: str, items: Column) -> Column:
        return F.transform(
            items, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text"), F.lit(WEIGHTS[kind]).cast("float").alias("weight"))
        )

    whole = tagged("query", F.array(collapse_whitespace(c)))
    inputs = F.concat(whole, tagged("keyword", keywords(c)), tagged("entity", entities(c)))
    return F.when(valid_text(c), inputs)


def excerpt(c: Column, size: int = 600) -> Column:
    return F.left(c, F.lit(size))
