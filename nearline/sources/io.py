"""Scans and sinks.

Schemas are declared (no inference) and malformed input fails fast unless the
caller asks otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearline.operators.indexing import with_global_index

PASSAGE_TYPE = T.StructType([T.StructField("docid", T.StringType()),
                             T.StructField("title", T.StringType()),
                             T.StructField("text", T.StringType())])
TRAIN_GROUP_SCHEMA = T.StructType([
    T.StructField("group_id", T.LongType()),
    T.StructField("query", T.StringType()),
    T.StructField("positives", T.ArrayType(PASSAGE_TYPE)),
    T.StructField("negatives", T.ArrayType(PASSAGE_TYPE)),
])
# Field names used by published training files.
_ALT_NAMES = {"positive_passages": "positives", "negative_passages": "negatives"}


def read_train_groups(spark: SparkSession, path: str, fmt: str = "json", mode: str = "FAILFAST",
                      split: str | None = None) -> DataFrame:
    """Training groups; accepts ``positive_passages``/``negative_passages`` names too.

    ``split`` reads only files whose name starts with it.  Rows without a
    ``group_id`` take their position in the scan (unique and increasing, not dense).
    """
    reader = spark.read.format(fmt)
    if split is not None:
        reader = reader.option("pathGlobFilter", f"{split}*")
    if fmt == "json":
        fields = list(TRAIN_GROUP_SCHEMA.fields) + [T.StructField(k, T.ArrayType(PASSAGE_TYPE))
                                                    for k in _ALT_NAMES]
        df = reader.schema(T.StructType(fields)).option("mode", mode).load(path)
    else:
        df = reader.load(path)
    cols = set(df.columns)
    out = []
    for f in TRAIN_GROUP_SCHEMA.fields:
        alts = [a for a, b in _ALT_NAMES.items() if b == f.name and a in cols]
        c = F.col(f.name) if f.name in cols else F.lit(None).cast(f.dataType)
        if alts:
            c = F.coalesce(c, F.col(alts[0]))
        if f.name == "group_id":
            c = F.coalesce(c.cast(f.dataType), F.monotonically_increasing_id())
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def parse_batch_lines(lines: DataFrame, top_k: int | None = None, value: str = "value") -> DataFrame:
    """S2 core: each line a JSON list of strings or an object {src, text: [...]}.

    List lines get ``src = ''``; texts are cut to the first ``top_k``.  A line
    that is neither (blank lines apart, which are skipped) raises.
    """
    lines = lines.where(F.length(F.trim(F.col(value))) > 0)
    as_list = F.from_json(F.col(value), T.ArrayType(T.StringType()))
    as_obj = F.from_json(F.col(value), T.StructType([T.StructField("src", T.StringType()),
                                                     T.StructField("text", T.ArrayType(T.StringType()))]))
    bad = F.raise_error(F.concat(F.lit("malformed batch line: "), F.substring(F.col(value), 1, 80)))
    texts = F.coalesce(as_list, as_obj["text"], bad.cast("array<string>"))
    if top_k is not None:
        texts = F.slice(texts, 1, int(top_k))
    src = F.when(as_list.isNotNull(), F.lit("")).otherwise(F.coalesce(as_obj["src"], F.lit("")))
    return lines.select(*[c for c in lines.columns if c != value], src.alias("src"), texts.alias("texts"))


def read_batches(spark: SparkSession, path: str, top_k: int | None = 8) -> DataFrame:
    """Batch lines file(s) -> batches(batch_id, src, texts).

    ``batch_id`` is unique per line (partition-ordered id of the scan).
    """
    lines = spark.read.text(path).withColumn("batch_id", F.monotonically_increasing_id())
    return parse_batch_lines(lines, top_k).select("batch_id", "src", "texts")


def batch_lines(batches: DataFrame, src: str = "src", texts: str = "texts", as_list: Column | None = None) -> DataFrame:
    """S9 core: batches -> JSON lines (object form, or list form where ``as_list``)."""
    obj = F.to_json(F.struct(F.col(src).alias("src"), F.col(texts).alias("text")))
    lst = F.to_json(F.col(texts))
    line = obj if as_list is None else F.when(as_list, lst).otherwise(obj)
    return batches.select(*[c for c in batches.columns if c not in (src, texts)], line.alias("value"))


def write_batches(batches: DataFrame, path: str, mode: str = "errorifexists", **kw) -> None:
    """Write JSON lines readable by S2."""
    batch_lines(batches, **kw).select("value").write.mode(mode).text(path)


def read_corpus(spark: SparkSession, path: str, id_col: str = "id", text_col: str = "text",
                title_col: str | None = None, fmt: str = "parquet") -> DataFrame:
    """S3: rows of (id, text[, title]) for encoding."""
    df = spark.read.format(fmt).load(path)
    cols = [F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    if title_col:
        cols.append(F.col(title_col).alias("title"))
    return df.select(*cols)


def shard(df: DataFrame, num_shards: int, key: str, mode: str = "contiguous", index: int | None = None,
          shard_col: str = "shard") -> DataFrame:
    """Disjoint shards whose union is the input.

    ``contiguous``: in ``key`` order, shard sizes n//k with the first n%k one
    larger; ``strided``: position % k; ``hash``: pmod(xxhash64(key), k), no sort.
    """
    k = int(num_shards)
    if mode == "hash":
        out = df.withColumn(shard_col, F.pmod(F.xxhash64(F.col(key)), F.lit(k)).cast("int"))
    else:
        idx = with_global_index(df, [key], "_nl_idx", with_total="_nl_n")
        i, n = F.col("_nl_idx"), F.col("_nl_n")
        if mode == "strided":
            s = i % k
        elif mode == "contiguous":
            base, rem = F.floor(n / k), n % k
            big = rem * (base + 1)
            s = F.when(i < big, F.floor(i / (base + 1))).otherwise(rem + F.floor((i - big) / F.greatest(base, F.lit(1))))
        else:
            raise ValueError(f"unknown shard mode {mode!r}")
        out = idx.withColumn(shard_col, s.cast("int")).drop("_nl_idx", "_nl_n")
    if index is not None:
        out = out.where(F.col(shard_col) == int(index))
    return out


def write_reps(reps: DataFrame, path: str, shard_col: str = "shard", mode: str = "errorifexists", files: int = 4) -> None:
    """Vectors + ids as Parquet, one folder per shard, of at most ``files`` files each.

    Rows are regrouped by shard first, so the number of files does not grow with the tasks.
    """
    part = F.pmod(F.xxhash64(*[c for c in reps.columns if c != shard_col]), F.lit(files))
    reps.repartition(F.col(shard_col), part).write.mode(mode).partitionBy(shard_col).parquet(path)


def read_reps(spark: SparkSession, path: str) -> DataFrame:
    """Read what ``write_reps`` wrote (shard comes back from the folder name)."""
    return spark.read.parquet(path)


def read_rep_shards(spark: SparkSession, pattern: str, provenance: bool = False) -> DataFrame:
    """Union of all shard files matching ``pattern``; empty match -> empty frame."""
    try:
        df = spark.read.parquet(pattern)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], "id bigint, rep array<float>")
        raise
    if provenance:
        df = df.withColumn("source_file", F.input_file_name())
    return df


def ranking_lines(run: DataFrame, decimals: int = 6) -> DataFrame:
    """S7 core: 'qid<TAB>docid<TAB>score' text with a fixed number of decimals."""
    line = F.concat_ws("\t", F.col("qid").cast("string"), F.col("docid").cast("string"),
                       F.format_string(f"%.{decimals}f", F.col("score")))
    return run.select("qid", "rank", line.alias("value"))


def write_ranking(run: DataFrame, path: str, num_files: int | None = None, mode: str = "errorifexists") -> None:
    """Ranking text, score descending per query, queries range-partitioned."""
    lines = ranking_lines(run)
    n = num_files or int(run.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (lines.repartitionByRange(n, "qid").sortWithinPartitions("qid", "rank")
     .select("value").write.mode(mode).text(path))


def pack_ranking(run: DataFrame) -> DataFrame:
    """One row per query with docid and score arrays in rank order."""
    g = run.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "docid", "score"))).alias("r"))
    return g.select("qid", F.transform("r", lambda s: s["docid"]).alias("docids"),
                    F.transform("r", lambda s: s["score"]).alias("scores"))
