"""Weighted text views of queries and pages, and their vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.ids import derived_uuid
from ..functions.vectors import is_valid, norm, weighted_centroid

MAX_INPUTS = 96
WEIGHTS = {
    "title": 1.5, "heading": 1.2, "summary": 1.1, "sentence": 0.7, "keyword": 0.6, "entity": 0.9, "url_signal": 0.5, "document": 1.0,
}
_TAGS = r"(?s)<[^>]*>"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def plain(c: Column) -> Column:
    """Text of a piece of markup on one line."""
    out = F.regexp_replace(c, _TAGS, " ")
    for reference, character in _ENTITIES:
        out = F.replace(out, F.lit(reference), F.lit(character))
    return text.collapse_whitespace(out)


def _all(html: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), plain), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Sentences of a text, cut after . ! ? before a blank; short ones are left out."""
    parts = F.split(text.collapse_whitespace(c), r"(?<=[.!?])\s+")
    return F.filter(parts, lambda s: F.char_length(s) >= 3)


def url_signals(url: Column) -> Column:
    """Words of the path of a URL that are not numbers."""
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    words = F.filter(F.split(text.ascii_lower(path), r"[^a-z0-9]+"), lambda w: (F.char_length(w) >= 2) & ~w.rlike(r"^\d+$"))
    return F.array_distinct(words)


def with_page_inputs(df: DataFrame, out: str, html: Column, url: Column, content: Column | None = None) -> DataFrame:
    """``df`` with an array of (kind, text, weight): title, headings, summary, sentences, keywords, entities, URL words.

    A page from which nothing comes gives its content as one document view. Texts
    are cut at 700 characters, kinds and texts are distinct, and at most 96 stay;
    sentences take the room that the other kinds leave.
    The cleaned page, its content and its sentences are columns on the way, so
    that what several views use is computed once.
    """
    names = [f"__{out}_{n}" for n in ("clean", "content", "sentences", "before", "after")]
    clean, text_of, parted, before, after = (F.col(n) for n in names)
    df = df.withColumn(names[0], F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "))
    body = _all(clean, r"(?is)<p\b[^>]*>(.*?)(?=</?p\b|</?article\b|</?div\b|$)")
    df = df.withColumn(names[1], F.array_join(body, " ") if content is None else content)
    df = df.withColumn(names[2], sentences(text_of))

    def tagged(kind: str, items: Column) -> Column:
        return F.transform(
            items, lambda x: F.struct(F.lit(kind).alias("kind"), F.left(x, F.lit(text.MAX_TEXT)).alias("text"), F.lit(WEIGHTS[kind]).cast("float").alias("weight"))
        )

    first = F.concat(
        tagged("title", F.slice(_all(clean, r"(?is)<title\b[^>]*>(.*?)</title"), 1, 1)),
        tagged("heading", _all(clean, r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]")), tagged("summary", F.slice(parted, 1, 1)),
    )
    last = F.concat(tagged("keyword", text.keywords(text_of)), tagged("entity", text.entities(text_of)), tagged("url_signal", url_signals(url)))
    df = df.withColumn(names[3], F.array_distinct(first)).withColumn(names[4], F.array_distinct(last))
    room = F.greatest(F.lit(MAX_INPUTS) - F.size(before) - F.size(after), F.lit(0))
    parts = F.concat(before, F.slice(F.array_distinct(tagged("sentence", parted)), F.lit(1), room), after)
    fallback = tagged("document", F.filter(F.array(text.collapse_whitespace(text_of)), lambda x: x != ""))
    df = df.withColumn(out, parts)
    df = df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(fallback))
    return df.withColumn(out, F.slice(F.array_distinct(out), 1, MAX_INPUTS)).drop(*names)


def exploded(df: DataFrame, key: list[str], inputs: Column) -> DataFrame:
    """A row an input with its ordinal and the hash of its text."""
    return df.select(*key, F.posexplode(inputs).alias("ordinal", "i")).select(
        *key, "ordinal", "i.kind", "i.text", F.sha2(F.col("i.text").cast("binary"), 256).alias("text_sha256"), "i.weight"
    )


def input_sets(df: DataFrame, subject_kind: str, subject: str, space: str, source: Column, inputs: Column, extractor: str, version: str) -> DataFrame:
    """Rows for semantic_input_sets, with ``inputs`` to be exploded into semantic_inputs."""
    key = ["tenant_id", "subject_kind", "subject_id", "embedding_space_id", "extractor_name", "extractor_version", "source_content_sha256"]
    out = df.select(
        "tenant_id", F.lit(subject_kind).alias("subject_kind"), F.col(subject).alias("subject_id"), F.lit(space).alias("embedding_space_id"),
        F.lit(extractor).alias("extractor_name"), F.lit(version).alias("extractor_version"),
        F.sha2(source.cast("binary"), 256).alias("source_content_sha256"), inputs.alias("inputs"),
    ).where(F.size("inputs") > 0)
    provenance = F.to_json(F.struct(F.size("inputs").alias("inputs")))
    return out.withColumn("input_set_id", derived_uuid(F.lit("input_set"), *[F.col(c) for c in key])).withColumn("provenance", provenance)


def input_report(inputs: DataFrame, key: str) -> DataFrame:
    """Inputs of each set by kind, without any text or vector: counts, sizes and weights."""
    return inputs.groupBy(key, "kind").agg(
        F.count("*").alias("inputs"), F.min("ordinal").alias("first_ordinal"), F.sum(F.char_length("text")).alias("characters"),
        F.round(F.sum(F.col("weight").cast("double")), 6).alias("weight"),
    )


def embed(inputs: DataFrame, embedder: Callable[[pd.Series], pd.Series], column: str = "text") -> DataFrame:
    """Inputs with ``embedding``: the embedder maps a batch of texts to a batch of vectors on the executors."""
    schema = T.StructType([*inputs.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(embedding=embedder(batch[column]))

    return inputs.mapInPandas(run, schema)


def output_errors(inputs: DataFrame, outputs: DataFrame, dimensions: int, model: str) -> DataFrame:
    """(set_id, errors) of the sets whose vectors are not one valid vector an input by the asked model.

    ``inputs`` has set_id and ordinal, ``outputs`` set_id, ordinal, model and embedding.
    """
    o = outputs.groupBy("set_id", "ordinal").agg(
        F.count("*").alias("n"), F.min(F.col("model") == model).alias("same_model"),
        F.min(is_valid(F.col("embedding"), F.lit(dimensions))).alias("valid"),
    )
    i = inputs.select("set_id", "ordinal", F.lit(True).alias("asked"))
    both = i.join(o, ["set_id", "ordinal"], "full")
    flag = F.filter(
        F.array(
            F.when(F.col("n").isNull(), "missing"), F.when(F.col("asked").isNull(), "unasked"), F.when(F.col("n") > 1, "repeated"),
            F.when(~F.col("same_model"), "other_model"), F.when(~F.col("valid"), "invalid_vector"),
        ),
        lambda x: x.isNotNull(),
    )
    return both.select("set_id", F.explode(flag).alias("e")).groupBy("set_id").agg(F.array_sort(F.collect_set("e")).alias("errors"))


def query_vectors(queries: DataFrame, embedder: Callable[[pd.Series], pd.Series], dimensions: int) -> DataFrame:
    """(query_id, status, centroid, inputs, length): each query text as one unit vector over its views."""
    inputs = exploded(queries, ["query_id"], text.query_inputs(F.col("query_text")))
    vectors = embed(inputs, embedder)
    pooled = weighted_centroid(vectors.where(is_valid(F.col("embedding"), F.lit(dimensions))), "query_id", "ordinal", "embedding", "weight")
    counts = vectors.groupBy("query_id").agg(F.count("*").alias("inputs"), F.count_if(~is_valid(F.col("embedding"), F.lit(dimensions))).alias("bad"))
    return pooled.join(counts, "query_id").select(
        "query_id", F.when(F.col("bad") > 0, "invalid_vector").otherwise(F.col("status")).alias("status"),
        F.when(F.col("bad") == 0, F.col("centroid")).alias("centroid"), "inputs", norm(F.col("centroid")).alias("length"),
    )


def in_order(outputs: DataFrame) -> DataFrame:
    """(set_id, position, index, embedding) of a provider's outputs in the order of their index, whatever order they came in.

    ``outputs`` has set_id, index and embedding. A set has the inputs of one subject, which the input checks bound.
    """
    listed = F.array_sort(F.collect_list(F.struct("index", "embedding")))
    sorted_ = outputs.groupBy("set_id").agg(listed.alias("o")).select("set_id", F.posexplode("o").alias("position", "o"))
    return sorted_.select("set_id", "position", "o.index", "o.embedding")


def new_input_vectors(vectors: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """Rows for semantic_input_vectors: the first vector of an input in a model space stays, as do stored ones."""
    key = ["input_id", "model", "model_version", "dimensions", "normalization"]
    first = Window.partitionBy(*key).orderBy(order)
    rows = vectors.withColumn("nth", F.row_number().over(first)).where("nth = 1").join(stored.select(*key), key, "left_anti")
    return rows.where(is_valid(F.col("embedding"), F.col("dimensions"))).select(
        "tenant_id", "input_id", "model", "model_version", "normalization", "dimensions", "embedding", "generated_at"
    )
