"""Prompt → text through a pluggable generator (M3), failures kept as data.

The generator is any object with ``generate(prompts: list[str]) -> list[str]``
(a hosted model client, a local model...). It runs in Arrow batches inside
``mapInPandas`` on the executors. A batch that fails is retried row by row,
so one bad prompt turns into one row with ``error`` set, not a failed job.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class TimedApart(Exception):
    """Prompts are timed one by one."""


def generate(df: DataFrame, prompt_col: str, generator, *, out_col: str = "recommendation",
             error_col: str = "error", skip_col: str | None = None,
             fallback: str | None = None, clock=None, seconds_col: str = "seconds") -> DataFrame:
    """Append ``out_col`` (stripped text) and ``error_col`` (NULL on success).

    Rows where ``skip_col`` is true are not sent to the generator; they get
    ``fallback`` (the no-match message), in the same pass.  With a ``clock`` (a callable
    that gives seconds, read in the worker) each prompt is a call of its own, and
    ``seconds_col`` holds what its call took, failed or not; 0 for skipped rows.
    """
    added = [T.StructField(out_col, T.StringType()), T.StructField(error_col, T.StringType())]
    if clock is not None:
        added.append(T.StructField(seconds_col, T.DoubleType()))
    fields = [f for f in df.schema.fields if f.name not in [a.name for a in added]]
    schema = T.StructType(fields + added)
    names = [f.name for f in fields]

    def run(batches):
        for pdf in batches:
            all_prompts = pdf[prompt_col].tolist()
            skip = pdf[skip_col].fillna(False).tolist() if skip_col else [False] * len(pdf)
            todo = [i for i, sk in enumerate(skip) if not sk]
            prompts = [all_prompts[i] for i in todo]
            outs: list = [fallback if sk else None for sk in skip]
            errs: list = [None] * len(all_prompts)
            took = [0.0] * len(all_prompts)
            try:
                if clock is not None:
                    raise TimedApart
                got = list(generator.generate(prompts)) if prompts else []
                if len(got) != len(prompts):
                    raise ValueError("generator returned a different number of texts")
                for i, g in zip(todo, got):
                    outs[i] = None if g is None else str(g).strip()
            except Exception:  # isolate the failing rows
                for i in todo:
                    began = clock() if clock else 0.0
                    try:
                        got = generator.generate([all_prompts[i]])[0]
                        outs[i] = None if got is None else str(got).strip()
                    except Exception as e:  # noqa: BLE001 - failure becomes data
                        errs[i] = f"{type(e).__name__}: {e}"
                    took[i] = clock() - began if clock else 0.0
            out = pdf[names].copy()
            out[out_col] = pd.Series(outs, dtype=object)
            out[error_col] = pd.Series(errs, dtype=object)
            if clock is not None:
                out[seconds_col] = took
            yield out

    return df.mapInPandas(run, schema)
