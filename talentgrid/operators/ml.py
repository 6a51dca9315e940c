"""Machine-learning dataflow on MLlib: text embeddings and the domain classifier.

The source used pretrained neural encoders and single-machine fine-tuning. Here the
encoder is a plug-in: by default a hashed TF-IDF vector (no model download, fully
distributed, deterministic); a caller may pass any batch encoder, which then runs as an
Arrow-batched pandas UDF. Training uses an MLlib pipeline.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentgrid.functions.vectors import l2_normalize
from talentgrid.session import materialize


def _hashed(df: DataFrame, text_col: str, dim: int) -> DataFrame:
    """Adds ``_tf``: hashed counts of the letter tokens of the text (sparse)."""
    df = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    tok = RegexTokenizer(inputCol="_text", outputCol="_tok", pattern=r"[^\p{L}]+", toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    return tf.transform(tok.transform(df)).drop("_text", "_tok")


def _vectors(hashed: DataFrame, out_col: str, normalize: bool, idf: bool) -> DataFrame:
    """``_tf`` to array vectors, weighted by the IDF over all rows if asked."""
    if idf:
        # read by the fit and by the rows: texts are cut into tokens once
        hashed = materialize(hashed)
        hashed = IDF(inputCol="_tf", outputCol="_v").fit(hashed).transform(hashed)
    out = hashed.withColumn(out_col, vector_to_array("_v" if idf else "_tf").cast("array<double>")).drop("_tf", "_v")
    return out.withColumn(out_col, l2_normalize(out_col)) if normalize else out


def embed_texts(df: DataFrame, text_col: str = "text", out_col: str = "embedding", dim: int = 256,
                normalize: bool = True, encoder: Callable[[list[str]], np.ndarray] | None = None,
                batch_size: int = 64, idf: bool = True) -> DataFrame:
    """Add ``embedding`` (array<double>). Default: hashed TF-IDF of letter tokens (IDF
    fitted on ``df``). With ``encoder`` (texts → [n, d] array) the encoder runs per Arrow
    batch of ``batch_size`` texts; its errors end the job. A null text counts as empty."""
    if encoder is None:
        return _vectors(_hashed(df, text_col, dim), out_col, normalize, idf)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def enc(texts: pd.Series) -> pd.Series:
        res = []
        for i in range(0, len(texts), batch_size):
            chunk = texts.iloc[i:i + batch_size].fillna("").tolist()
            res.extend(list(np.asarray(encoder(chunk), dtype=np.float64)))
        return pd.Series(res)
    out = df.withColumn(out_col, enc(F.col(text_col)))
    if normalize:
        out = out.withColumn(out_col, l2_normalize(out_col))
    return out


def batch_embedding_map(df: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """Embed each distinct text once and join the vectors back (key = md5 of the text)."""
    keyed = df.withColumn("_key", F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    uniq = keyed.select("_key", text_col).dropDuplicates(["_key"])
    out_col = kw.get("out_col", "embedding")
    if kw.get("encoder") is None:
        # the hashed counts stand for the text from here on
        hashed = _hashed(uniq, text_col, kw.get("dim", 256)).select("_key", "_tf")
        emb = _vectors(hashed, out_col, kw.get("normalize", True), kw.get("idf", True))
    else:
        emb = embed_texts(uniq, text_col, **kw).select("_key", out_col)
    return keyed.join(emb, "_key").drop("_key")


def train_domain_classifier(df: DataFrame, text_col: str, label_col: str, eval_df: DataFrame,
                            num_features: int = 4096, max_iter: int = 50, reg: float = 0.01):
    """Fit tokenizer → hashed TF → IDF → multinomial logistic regression on ``df``;
    returns (model, predictions on ``eval_df`` with ``prediction``). A null text is empty."""
    df, eval_df = (x.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(""))) for x in (df, eval_df))
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[^\p{L}]+", toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol=label_col, maxIter=max_iter, regParam=reg,
                            family="multinomial")
    # the label and the sparse counts are all that the fits read: texts are cut into tokens once
    counted = materialize(tf.transform(tok.transform(df)).select(label_col, "_tf"))
    fitted = Pipeline(stages=[idf, lr]).fit(counted)
    model = PipelineModel([tok, tf, *fitted.stages])
    return model, model.transform(eval_df)
