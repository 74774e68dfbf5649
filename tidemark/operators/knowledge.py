"""Knowledge documents: union, ids, chunks, keyword lookups, chat search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocab
from ..sources.tables import spread, staged
from .keywords import keyword_hits
from .ordering import row_numbers

COLUMNS = ["doc_type", "source", "title", "chapter", "category", "doc_id", "page_content"]


def union_documents(*parts: DataFrame) -> DataFrame:
    """Documents of all kinds with the same columns."""
    return reduce(DataFrame.unionByName, (p.select(*COLUMNS) for p in parts))


def with_answers(df: DataFrame, *columns: str, least: int = 1) -> DataFrame:
    """Rows whose texts are not blank, nor shorter than `least` characters."""
    return df.filter(reduce(Column.__and__, (F.length(F.trim(F.col(c))) >= least for c in columns)))


def numbered(df: DataFrame, prefix: str, digits: int, *order: str) -> DataFrame:
    """Ids prefix + number from 0 in a declared order."""
    return row_numbers(df, "__n", order).withColumn("doc_id", F.format_string(f"{prefix}%0{digits}d", F.col("__n") - 1)).drop("__n")


def chunk_documents(df: DataFrame, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """a row for each chunk with its index; the id holds source, position of the item and chunk."""
    out = df.select(*[c for c in df.columns if c != text], F.posexplode(tx.chunker(size, overlap)(F.col(text))).alias("chunk_index", "page_content"))
    return out.withColumn("doc_id", F.concat_ws("_", tx.doc_id(F.col("source")), F.col("pos").cast("string"), F.col("chunk_index").cast("string")))


def qa_documents(df: DataFrame) -> DataFrame:
    """documents from questions and answers."""
    topic = F.coalesce(F.nullif("category", F.lit("")), tx.category(F.col("question"), F.col("answer"), F.col("title")))
    return with_answers(df, "question", "answer").withColumn("category", topic).withColumns({
        "doc_type": F.lit("qa"), "page_content": tx.qa_text(F.col("category"), F.col("title"), F.col("question"), F.col("answer"))})


def faq_matches(questions: DataFrame, faq: DataFrame) -> DataFrame:
    """Per question, the FAQ rows with a keyword inside it, or all for a request of the list, in FAQ order.

    faq: (pos, question, answer, keywords), pos being unique. Keywords are found by one scan of
    each question; the whole list is put together once.
    """
    shown = F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer").alias("shown")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda x: x["shown"]), "\n\n").alias("faq")
    words = faq.select("pos", F.explode("keywords").alias("k")).select("pos", tx.plain(F.col("k")).alias("keyword")).filter("keyword <> ''").distinct()
    asked = staged(spread(questions).select("id", tx.plain(F.col("text")).alias("text")).withColumn("wants", F.col("text").rlike("|".join(vocab.LIST_WORDS))), "questions")
    some = keyword_hits(asked.filter("not wants"), words).join(words, "keyword").select("id", "pos").distinct()
    found = some.join(faq.select("pos", shown), "pos").groupBy("id").agg(text, F.count("*").alias("n_faq"))
    # one row, whose text every request of the list gets
    whole = faq.select("pos", shown).agg(F.struct(text, F.count("*").alias("n_faq")).alias("x")).filter("x.n_faq > 0")
    every = asked.filter("wants").select("id").distinct().withColumn("x", whole.scalar()).filter("x is not null").select("id", "x.*")
    return found.unionByName(every)


def standard_names(df: DataFrame, synonyms: DataFrame, word: str, to: str) -> DataFrame:
    """The standard name of a word, lower-cased and trimmed; unknown words stay. synonyms: (word, standard), one row a word."""
    s = synonyms.select(F.col("word").alias("__w"), F.col("standard").alias("__s"))
    return df.join(s, F.lower(F.trim(F.col(word))) == F.col("__w"), "left").withColumn(to, F.coalesce("__s", word)).drop("__w", "__s")


def correct_arguments(df: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Known words in the id fields move to an empty name, else go; then the name becomes standard.

    Rows without any argument get an error text.
    """
    words = synonyms.select(F.col("word").alias("__w"), F.col("standard").alias("__s"))
    out = df.withColumn("error", F.when(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("name", "id_val", "id_num")]).isNull(), "no argument"))
    for field in ("id_val", "id_num"):
        known = F.col("__w").isNotNull()
        out = out.join(words, F.lower(F.trim(F.col(field))) == F.col("__w"), "left")
        out = out.withColumn("name", F.when(known & (F.coalesce(F.trim("name"), F.lit("")) == ""), F.col(field)).otherwise(F.col("name"))).withColumn(field, F.when(~known, F.col(field))).drop("__w", "__s")
    return standard_names(out, synonyms, "name", "name")


def predictability(items: DataFrame, metadata: DataFrame, key: str = "item_name") -> DataFrame:
    """Code and lifespan of items that the forecast knows, as one struct; null for others."""
    m = metadata.select(key, F.struct("code", "lifespan").alias("prediction"))
    return items.join(m, key, "left").withColumn("is_predictable", F.col("prediction").isNotNull())


def search_messages(messages: DataFrame, word: str | None) -> DataFrame:
    """Messages that hold a word in any case; all without one."""
    return messages.filter(F.contains(F.lower("content"), F.lit(word.lower()))) if word else messages


def fixed_answers(queries: DataFrame, context: DataFrame, answer: str) -> DataFrame:
    """queries without any final document get a fixed answer."""
    n = context.groupBy("q").agg(F.count("*").alias("n_docs"))
    return queries.join(n, "q", "left").withColumns({"n_docs": F.coalesce("n_docs", F.lit(0).cast("long")), "answer": F.when(F.col("n_docs").isNull(), answer)})


def item_summary(df: DataFrame, item: str) -> DataFrame:
    """Distinct items and rows of a table."""
    return df.agg(F.countDistinct(item).alias("n_items"), F.count("*").alias("n_rows"))


def skip_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that have no result yet."""
    return df.join(done.select(key), key, "left_anti")


def holders_of(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of listed ids."""
    return df.join(ids.select(key), key, "left_semi")


def distinct_lists(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of some columns."""
    return df.select(*columns).distinct()
