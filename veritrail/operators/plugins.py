"""What users can put in: evidence providers, claim extractors, classifiers, baselines and stages.

Each is a function of DataFrames or columns. A set of them is a dict by name, in order; ``with_entry`` gives
a new dict, so one user's choice does not change another's.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (claims, k) -> evidence with claim_id, text, source, score.
Provider = Callable[[DataFrame, int], DataFrame]
#: texts (id, text) -> claims (id, pos, claim).
Extractor = Callable[[DataFrame], DataFrame]
#: text column -> type.
Classifier = Callable[[Column], Column]
#: rows -> column of probabilities, fitted on them where it has to be.
Baseline = Callable[[DataFrame], Column]
Stage = Callable[[DataFrame], DataFrame]


def with_entry(entries: Mapping[str, Callable], name: str, entry: Callable) -> dict[str, Callable]:
    """``entries`` and one more, after them; an error if the name is taken."""
    if name in entries:
        raise ValueError(f"{name!r} is registered already")
    return {**entries, name: entry}


def retrieve_all(claims: DataFrame, providers: Mapping[str, Provider], k: int) -> DataFrame:
    """provider, claim_id, text, source, score: what every provider finds."""
    out = None
    for name, f in providers.items():
        found = f(claims, k).select(F.lit(name).alias("provider"), "claim_id", "text", "source", F.col("score").cast("double").alias("score"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no providers")
    return out


def extract_with(texts: DataFrame, extractors: Mapping[str, Extractor]) -> DataFrame:
    """extractor, id, pos, claim."""
    out = None
    for name, f in extractors.items():
        found = f(texts).select(F.lit(name).alias("extractor"), "id", F.col("pos").cast("int").alias("pos"), "claim")
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no extractors")
    return out


def classify_with(df: DataFrame, text: str, classifiers: Mapping[str, Classifier]) -> DataFrame:
    """``df`` with one column of types for each classifier."""
    return df.withColumns({name: f(F.col(text)) for name, f in classifiers.items()})


def score_with(df: DataFrame, baselines: Mapping[str, Baseline]) -> DataFrame:
    """``df`` with one column of probabilities for each baseline."""
    return df.withColumns({name: f(df) for name, f in baselines.items()})


def run_stages(df: DataFrame, stages: Mapping[str, Stage]) -> DataFrame:
    """The stages one after the other."""
    for f in stages.values():
        df = df.transform(f)
    return df
