"""Readers. Every reader returns a DataFrame with an explicit schema and, where the
source order matters, an ``ord`` struct column built from (file class, file time,
path, position in file) so later keep-first / limit steps are deterministic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid import vocab as V
from talentgrid.sources import schemas as SC


def _file_cols() -> list[Column]:
    return [F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_name").alias("_name"),
            F.col("_metadata.file_modification_time").alias("_mtime")]


def read_offers(spark: SparkSession, path: str) -> DataFrame:
    """Offer JSON files of two shapes: a batch ``{"jobs": [...]}`` or a single offer
    (kept only when it has a title and a company). Unreadable files are skipped
    (permissive parsing, corrupt records dropped). Adds ``_file``, ``_name``,
    ``_mtime``, ``_pos`` (position inside the file)."""
    raw = (spark.read.schema(SC.OFFER_FILE).option("multiLine", "true").option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
           .select("*", *_file_cols()))
    raw = raw.filter(F.col("_corrupt_record").isNull())
    single = F.struct(*[F.col(f.name) for f in SC.OFFER.fields])
    is_single = F.col("jobs").isNull() & F.col("title").isNotNull() & (F.col("title") != "") \
        & F.col("company").isNotNull() & (F.col("company") != "")
    arr = F.when(F.col("jobs").isNotNull(), F.col("jobs")).when(is_single, F.array(single))
    out = raw.select("_file", "_name", "_mtime", F.posexplode(arr).alias("_pos", "o"))
    return out.select("o.*", "_file", "_name", "_mtime", "_pos")


def file_class(name: Column) -> Column:
    """0 batch files, 1 individual offers, 2 emergency backups."""
    return (F.when(name.startswith("batch_"), F.lit(0))
            .when(name.startswith("emergency_backup_"), F.lit(2)).otherwise(F.lit(1)))


def read_offers_prioritised(spark: SparkSession, path: str, max_results: int | None, domain: str | None = None,
                            country_code: str | None = None) -> DataFrame:
    """Batch files first, then individual offers, then emergency backups, newest file
    first; domain/country filters; the first occurrence of an id wins (offers without
    id are all kept); cut at ``max_results`` in that order (None: no cut); then sort by score (the cut
    happens before the sort, as in the source)."""
    from talentgrid.operators.dedup import keep_first
    o = read_offers(spark, path)
    o = o.withColumn("_cls", file_class(F.col("_name")))
    if domain:
        o = o.filter(F.col("domain") == domain)
    if country_code:
        o = o.filter(F.col("country") == V.COUNTRY_NAMES.get(country_code, country_code))
    o = o.withColumn("ord", F.struct("_cls", (-F.col("_mtime").cast("long")).alias("_t"), "_file", "_pos"))
    with_id = keep_first(o.filter(F.col("id").isNotNull()), ["id"], "ord")
    kept = with_id.unionByName(o.filter(F.col("id").isNull()))
    capped = kept if max_results is None else kept.orderBy("ord").limit(max_results)
    return capped.orderBy(F.coalesce(F.col("match_score"), F.col("score")).desc_nulls_last(), "ord")


def read_offers_reimport(spark: SparkSession, path: str, max_jobs: int = 0) -> DataFrame:
    """Batch files first, then individual ones; offers without id dropped; first id wins;
    optional cap (0 = none)."""
    from talentgrid.operators.dedup import keep_first
    o = read_offers(spark, path).filter(F.col("id").isNotNull() & (F.col("id") != ""))
    o = o.withColumn("ord", F.struct(F.when(F.col("_name").startswith("batch_"), 0).otherwise(1).alias("_c"),
                                     "_file", "_pos"))
    out = keep_first(o, ["id"], "ord")
    return out.orderBy("ord").limit(max_jobs) if max_jobs > 0 else out


def read_cv_text(spark: SparkSession, path: str) -> DataFrame:
    """CV text files → (cv_id = file stem, path, text); UTF-8 when valid, else Latin-1."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    raw = F.col("content")
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))
    return b.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("cv_id"), "path", text.alias("text"))


#: Column names of at most so many files are shipped to every task (a few hundred bytes a file).
MAX_FILES_SHIPPED = 20_000


def _column_for(kind: str, names: Column, source: Column, known: dict) -> Column:
    """The file's column for ``kind``: what the known layout says, else the first name that
    holds one of the words (any case), for the text else the first column."""
    words = "|".join(V.TRAINING_COLUMN_WORDS[kind])
    out = F.get(F.filter(names, lambda c: F.lower(c).rlike(words)), F.lit(0))
    if kind == "text":
        out = F.coalesce(out, F.get(names, F.lit(0)))
    for pattern, cols in known.items():
        out = F.when(source.contains(pattern), F.lit(cols.get(kind)).cast("string")).otherwise(out)
    return out


def _with_file_columns(rows: DataFrame, names: DataFrame, n_files: int) -> DataFrame:
    """Every row with its file's column names; ``names`` has one row a file, so it is shipped to
    the rows while the files are at most MAX_FILES_SHIPPED and joined otherwise."""
    return rows.join(F.broadcast(names) if n_files <= MAX_FILES_SHIPPED else names, "source")


def _csv_sources(spark: SparkSession, paths: list[str], known: dict) -> DataFrame:
    """Headers first, from the first lines of the files; then one positional scan as wide as the
    widest header, in which every file's own header says what stands where."""
    from talentgrid.session import materialize
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("source"), F.regexp_replace("value", "^\\ufeff", "").alias("line"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_i"))
    first = (lines.filter((F.col("_start") == 0) & (F.trim("line") != ""))
             .groupBy("source").agg(F.min_by("line", "_i").alias("line")))
    cells = F.transform(F.split("line", r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.replace(
        F.regexp_replace(F.trim(c), r'^"|"$', ""), F.lit('""'), F.lit('"')))
    names = materialize(first.select("source", cells.alias("_names")))
    width = names.agg(F.max(F.size("_names"))).first()[0] or 1
    raw = (spark.read.schema(", ".join(f"_c{i} string" for i in range(width))).option("header", "true")
           .option("multiLine", "true").option("quote", '"').option("escape", '"').csv(paths))
    rows = raw.select(F.col("_metadata.file_path").alias("source"), F.array(*[f"_c{i}" for i in range(width)]).alias("_cells"),
                      F.monotonically_increasing_id().alias("_row"))
    x = _with_file_columns(rows, names, len(raw.inputFiles()))
    return x.select("source", *[F.get("_cells", F.array_position("_names", _column_for(k, F.col("_names"), F.col("source"), known))
                                      .cast("int") - 1).alias(k) for k in V.TRAINING_COLUMN_WORDS], "_row")


def _json_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """An array of objects or a single object a file; the columns of a file are the keys of all
    its objects in alphabetical order."""
    raw = spark.read.text(paths, wholetext=True)
    whole = F.coalesce(F.from_json("value", "array<map<string,string>>"),
                       F.array(F.from_json("value", "map<string,string>")))
    rows = raw.select(F.col("_metadata.file_path").alias("source"), F.explode(whole).alias("_cells")) \
        .withColumn("_row", F.monotonically_increasing_id())
    keys = rows.select("source", F.explode(F.map_keys("_cells")).alias("_k")).distinct()
    names = keys.groupBy("source").agg(F.array_sort(F.collect_set("_k")).alias("_names"))
    x = _with_file_columns(rows, names, len(raw.inputFiles()))

    def cell(kind):
        v = F.try_element_at("_cells", _column_for(kind, F.col("_names"), F.col("source"), {}))
        items = F.when(v.startswith("["), F.from_json(v, "array<string>"))
        return F.coalesce(F.array_join(items, ", "), v).alias(kind)
    return x.select("source", *[cell(k) for k in V.TRAINING_COLUMN_WORDS], "_row")


def read_training_sources(spark: SparkSession, sources: list[str], known: dict | None = None) -> DataFrame:
    """Many CSV/JSON files (or folders of them, told apart by the suffix) → (source, text,
    category, skills, _row), two scans for all files of a format however many they are and
    however their columns differ. CSV files of a ``known`` layout (file-name part →
    column per kind) are read by it, all others by the words in their column names.

    A header is one line; a JSON file fits in a string (2 GB); lists of strings are joined by ", ";
    unreadable JSON and files without rows give none; cells that a row lacks are null; values are
    kept as written (no number or date is parsed)."""
    known = V.KNOWN_TRAINING_FILES if known is None else known
    is_json = lambda s: s.lower().rstrip("/").endswith(".json")
    js, cs = [s for s in sources if is_json(s)], [s for s in sources if not is_json(s)]
    frames = ([_csv_sources(spark, cs, known)] if cs else []) + ([_json_sources(spark, js)] if js else [])
    if not frames:
        return spark.createDataFrame([], "source string, text string, category string, skills string, _row long")
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def read_text_csv(spark: SparkSession, path: str, column: str) -> DataFrame:
    """CSV with a named text column; null → ''. Fails fast when the column is missing."""
    df = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    if column not in df.columns:
        raise ValueError(f"column {column!r} not in {df.columns}")
    return df.select(F.coalesce(F.col(column), F.lit("")).alias(column))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """JSON object keyed by cv_id → one row per CV."""
    from pyspark.sql import types as T
    t = spark.read.text(path, wholetext=True)
    m = F.from_json("value", T.MapType(T.StringType(), SC.ANNOTATION))
    return t.select(F.explode(m).alias("cv_id", "a")).select("cv_id", "a.*")


def read_feedback(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Feedback history → (sessions, ratings with their position ``pos``)."""
    h = spark.read.schema(SC.FEEDBACK_FILE).option("multiLine", "true").json(path)
    sessions = h.select(F.explode("sessions").alias("s")).select("s.*")
    ratings = sessions.select("session_id", "cv_domain", F.posexplode("feedback.job_ratings").alias("pos", "r")) \
        .select("session_id", "cv_domain", "pos", "r.*")
    return sessions, ratings


def storage_summary(spark: SparkSession, path: str, now: str) -> DataFrame:
    """Files per class and files modified within a day of ``now`` (file metadata only)."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path", "modificationTime")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    recent = F.col("modificationTime") >= F.to_timestamp(F.lit(now)) - F.expr("INTERVAL 1 DAY")
    return b.groupBy(file_class(name).alias("file_class")).agg(
        F.count(F.lit(1)).alias("files"), F.sum(recent.cast("int")).alias("modified_last_day"))
