"""Functions of the user in the place of models: called by partition, in batches of bounded size, failures as rows.

A provider is made once for each task by a factory, so that it can load a model or open a connection; then it gets lists of
inputs and gives as many outputs. A batch that raises is tried again an input at a time, so that one bad input doesn't
fail its neighbours; what fails again has a null output and the reason in a column. Tasks that are run again call the
provider again, so calls should have no side effects. The tests' providers are plain functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import without_fence


class Provider(Protocol):
    def __call__(self, inputs: Sequence[Any]) -> Sequence[Any]: ...


def called(rows: DataFrame, factory: Callable[[], Provider], given: Column, kind: str | T.DataType, into: str = "output", size: int = 16) -> DataFrame:
    """``rows`` with ``into``, what the provider gives for ``given`` (of type ``kind``), and ``into``_error.

    The provider sees at most ``size`` inputs at once. Null inputs aren't sent and give null without an error; a provider
    that gives another number of outputs has failed."""
    kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    schema = T.StructType([*rows.schema.fields, T.StructField(into, kind), T.StructField(f"{into}_error", T.StringType())])
    columns = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()

        def ask(inputs: list) -> list[tuple[Any, str | None]]:
            try:
                out = list(provider(inputs))
                if len(out) != len(inputs):
                    raise ValueError(f"{len(out)} outputs for {len(inputs)} inputs")
                return [(x, None) for x in out]
            except Exception as e:
                return [(None, f"{type(e).__name__}: {e}")] if len(inputs) == 1 else [ask([x])[0] for x in inputs]

        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size].reset_index(drop=True)
                sent = [k for k, x in enumerate(part["#given"]) if x is not None and not (isinstance(x, float) and x != x)]
                found = dict(zip(sent, ask([part["#given"][k] for k in sent]) if sent else []))
                part[into] = pd.Series([found.get(k, (None, None))[0] for k in range(len(part))], dtype=object)
                part[f"{into}_error"] = pd.Series([found.get(k, (None, None))[1] for k in range(len(part))], dtype=object)
                yield part[[*columns, into, f"{into}_error"]]

    return rows.withColumn("#given", given).mapInPandas(run, schema)


def embedded(rows: DataFrame, factory: Callable[[], Provider], text: str = "content", into: str = "embedding", size: int = 64) -> DataFrame:
    """``rows`` with vectors of a model, and ``into``_error where it failed."""
    return called(rows, factory, F.col(text), "array<float>", into, size)


def structured(rows: DataFrame, factory: Callable[[], Provider], prompt: Column, schema: str, into: str = "reply", size: int = 5) -> DataFrame:
    """``rows`` with ``into``, the reply to a prompt read as JSON of ``schema`` (DDL), with or without a code fence, and
    ``into``_error: what the provider raised, or ``not json``. Fields that are missing are null."""
    raw = called(rows, factory, prompt, "string", "#raw", size)
    read = F.from_json(without_fence(F.col("#raw")), f"{schema}, `#bad` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "#bad"})
    out = raw.withColumn("#read", read)
    bad = F.col("#read").isNull() | F.col("#read")["#bad"].isNotNull()
    error = F.coalesce(F.col("#raw_error"), F.when(F.col("#raw").isNotNull() & bad, "not json"))
    names = T._parse_datatype_string(schema).names
    reply = F.when(~bad, F.struct(*[F.col("#read")[n].alias(n) for n in names]))
    return out.withColumns({into: reply, f"{into}_error": error}).drop("#raw", "#raw_error", "#read")
