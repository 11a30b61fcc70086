"""Raw, clean and tokenised records: JSON lines and Parquet, and what evaluation reads and writes."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.stopwords import DEFAULT

RAW = "id string, title string, abstract string, categories string"
CLEAN = "id string, categories string, clean_title string, clean_abstract string"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master that names none gets a temporary one."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if not named.isDefined():
        path = sc.getConf().get("spark.checkpoint.dir", None)
        if not path and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="quillspark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The table written to the shared checkpoint folder; its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str, kept: set[str]) -> None:
    """Removes the folders two levels below ``path`` (``a/b``) that aren't among ``kept``.

    Through Spark's own file system classes, so of classic sessions only.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for a in fs.listStatus(top):
        for b in fs.listStatus(a.getPath()) if a.isDirectory() else ():
            if b.isDirectory() and f"{a.getPath().getName()}/{b.getPath().getName()}" not in kept:
                fs.delete(b.getPath(), True)


def read_jsonl(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """One object a line; broken and blank lines are left out, missing fields are null."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def sanitize(raw: DataFrame) -> DataFrame:
    """id, categories, clean_title, clean_abstract; missing values become ''."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return raw.select(empty("id").alias("id"), empty("categories").alias("categories"), T.clean(F.col("title")).alias("clean_title"), T.clean(F.col("abstract")).alias("clean_abstract"))


def tokenize(sanitized: DataFrame, stop_words: Sequence[str] = DEFAULT) -> DataFrame:
    """id, categories, title_tokens, abstract_tokens."""
    return sanitized.select("id", "categories", T.tokens(F.col("clean_title"), stop_words).alias("title_tokens"), T.tokens(F.col("clean_abstract"), stop_words).alias("abstract_tokens"))


def embedding_texts(sanitized: DataFrame) -> DataFrame:
    """id and what an encoder reads: title, '. ' and abstract."""
    return sanitized.select("id", F.trim(F.concat("clean_title", F.lit(". "), "clean_abstract")).alias("text"))


def titles(sanitized: DataFrame) -> DataFrame:
    """doc_id, title of each id; a missing title is "No Title".

    Of repeated ids the last row's title counts, by file and place in it where the rows come from files.
    """
    row = F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"))
    rows = sanitized.select(F.col("id").alias("doc_id"), F.coalesce("clean_title", F.lit("No Title")).alias("title"), row.alias("row"))
    return rows.groupBy("doc_id").agg(F.max_by("title", "row").alias("title"))


def write_tokenized(tokenized: DataFrame, path: str) -> None:
    """JSON lines with the tokens of title and abstract as lists."""
    tokenized.write.mode("overwrite").json(path)


def corpus(documents: DataFrame, title_words: int = 8) -> DataFrame:
    """id, title, abstract of the documents table: the first words of the clean text, and the rest."""
    parts = F.split(T.clean(F.col("text")), " ", title_words + 1)  # the last part is the rest as a whole
    cut = documents.select(F.col("doc_id").alias("id"), parts.alias("p"))
    return cut.select("id", F.array_join(F.slice("p", 1, title_words), " ").alias("title"), F.coalesce(F.get("p", F.lit(title_words)), F.lit("")).alias("abstract"))


def parted(documents: DataFrame, title_words: int = 8) -> DataFrame:
    """``corpus`` with its white space as it was, for what takes words only: only the beginning of a text is looked at."""
    text = F.make_valid_utf8(F.coalesce("text", F.lit("")))
    white, other = T.WHITE[:-1], f"[^{T.WHITE[1:-2]}]"
    first = documents.select(F.col("doc_id").alias("id"), text.alias("t")).withColumn("title", F.regexp_extract("t", f"^(?:{white}*+{other}++){{0,{title_words}}}+", 0))
    return first.select("id", "title", F.substr("t", F.length("title") + 1).alias("abstract"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """query_id, pos, neighbor_id of one JSON object of lists."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return whole.select(F.explode("m").alias("query_id", "n")).select("query_id", F.posexplode("n").alias("pos", "neighbor_id"))


def read_truth_lines(spark: SparkSession, path: str) -> DataFrame:
    """query_id, pos, neighbor_id of what ``write_truth`` wrote: lines, which are read in parallel."""
    rows = spark.read.schema("query_id string, neighbors array<string>").option("mode", "DROPMALFORMED").json(path)
    return rows.select("query_id", F.posexplode("neighbors").alias("pos", "neighbor_id"))


def truth_queries(raw: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, text: the raw abstracts of the ids that ``truth`` asks for."""
    ids = truth.select(F.col("query_id").alias("id")).distinct()
    return raw.join(ids, "id", "left_semi").select(F.col("id").alias("query_id"), F.col("abstract").alias("text"))


def write_truth(truth: DataFrame, path: str) -> None:
    """One JSON line for each query: query_id and its neighbours in order."""
    lists = truth.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "neighbor_id"))), lambda x: x["neighbor_id"]).alias("neighbors"))
    lists.write.mode("overwrite").json(path)


def read_recalls(spark: SparkSession, path: str) -> DataFrame:
    """recall, k1, b (to one decimal) of a JSON list of triples."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<double>>")).alias("r"))
    return rows.select(F.col("r")[0].alias("recall"), F.col("r")[1].alias("k1"), F.round(F.col("r")[2], 1).alias("b"))


def first_rows(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    return df.orderBy(key).limit(n)


def random_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows drawn without replacement, or all if there are fewer."""
    return df.orderBy(F.rand(seed)).limit(n)


def fixed(x: Column, places: int = 4) -> Column:
    """``x`` with ``places`` decimals as C's printf writes it: the exact value of the double rounded, ties to even.

    Java's formatter rounds the shortest decimal that stands for the double, so 0.97145, which is a little less
    than that, would be rounded up.  The product with the power of ten and its rounding error are taken apart, and the
    error decides where the product seems to lie halfway.
    """
    power = 10**places
    x = x.cast("double")
    halves = lambda v: ((v * 134217729.0) - ((v * 134217729.0) - v))  # noqa: E731  # the upper 26 bits
    high, product = halves(x), x * float(power)  # a power of ten of 26 bits or less is its own upper half
    error = (high * float(power) - product) + (x - high) * float(power)
    near = F.rint(product)
    near = near + F.when((product - near == 0.5) & (error > 0), 1.0).when((product - near == -0.5) & (error < 0), -1.0).otherwise(0.0)
    whole = F.abs(near).cast("long")
    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.floor(whole / F.lit(power)).cast("string"), F.lit("."), F.lpad((whole % power).cast("string"), places, "0"))


def report(results: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, rank, line: results with their titles as text; unknown ids say so."""
    joined = results.join(names, "doc_id", "left")
    line = F.format_string("%d. [Score: %s] %s (ID: %s)", F.col("rank").cast("int"), fixed(F.col("score")), F.coalesce("title", F.lit("Title not found.")), F.col("doc_id").cast("string"))
    return joined.select("query_id", "rank", line.alias("line"))


def ranked(scores: DataFrame, k: int, ties: str = "doc_id") -> DataFrame:
    """query_id, rank, doc_id, score: the ``k`` best of each query; ties by the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(ties))
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
