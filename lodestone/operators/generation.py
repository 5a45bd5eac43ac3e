"""Answers by a text generator, with another one behind it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..defaults import Settings
from ..functions.numbers import estimate_usd
from .answers import compose_demo


@dataclass(frozen=True)
class Provider:
    """call(question, prompt, model) gives answer, input_tokens, output_tokens; important questions may have a model of their own."""

    name: str
    model: str
    call: Callable[[str, str, str], dict]
    important_model: str = ""
    configured: bool = True


def routed(name: str | None, providers: dict[str, Provider], default: str = "gemini", allow_mock: bool = True) -> Provider | None:
    """The provider that a setting names, None for the extracted answer.

    No name is the default; an unknown one is an error. One that isn't configured gives way to the extracted answer if
    that is allowed.
    """
    wanted = default if name is None else name.strip().lower()
    if wanted == "mock":
        return None
    if wanted not in providers:
        raise ValueError(f"unsupported provider: {wanted}")
    chosen = providers[wanted]
    if not chosen.configured and not allow_mock:
        raise ValueError(f"provider isn't configured: {wanted}")
    return chosen if chosen.configured else None


def answer_mode(name: str | None, providers: dict[str, Provider], default: str = "gemini", allow_mock: bool = True) -> str:
    """How answers are made: a provider's name, `mock`, `mock-fallback`, or that a provider isn't configured."""
    wanted = default if name is None else name.strip().lower()
    chosen = routed(name, providers, default)
    return wanted if chosen or wanted == "mock" else "mock-fallback" if allow_mock else f"{wanted}-unconfigured"


KIND = "query_id {0}, answer string, provider string, model string, input_tokens int, output_tokens int, total_tokens int, fallback_reason string"


def extract(rows: DataFrame) -> DataFrame:
    """(query_id, answer) from the context itself: no generator."""
    c = rows.select("query_id", F.explode("chunks").alias("c")).select("query_id", F.col("c.rank").alias("rank"), F.col("c.content").alias("content"), F.col("c.similarity").alias("similarity"))
    return compose_demo(rows.select("query_id", "question"), c)


def generate(rows: DataFrame, provider: Provider | None, settings: Settings | None = None) -> DataFrame:
    """(query_id, answer, provider, model, tokens, estimated_cost_usd, fallback_reason) of rows (query_id, question, prompt, chunks, maybe important).

    Without a provider, and where its call fails or gives nothing, the answer is extracted and provider is `mock`.
    """
    rows = rows if "important" in rows.columns else rows.withColumn("important", F.lit(False))
    plain = extract(rows).withColumnRenamed("answer", "extracted")
    kind = KIND.format(rows.schema["query_id"].dataType.simpleString())
    names = [c.split()[0] for c in kind.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for q, question, prompt, important in f[["query_id", "question", "prompt", "important"]].itertuples(index=False):
                model = provider.important_model if important and provider.important_model.strip() else provider.model
                try:
                    got = provider.call(question, prompt, model)
                    if not (got.get("answer") or "").strip():
                        raise ValueError("empty answer")
                    i, o = got.get("input_tokens"), got.get("output_tokens")
                    out.append((q, got["answer"], provider.name, model, i, o, None if i is None or o is None else i + o, None))
                except Exception as e:  # noqa: BLE001 - a generator may fail in any way
                    out.append((q, None, "mock", "demo-extractive", None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=names).astype({c: "Int32" for c in ("input_tokens", "output_tokens", "total_tokens")})

    if provider is None:
        made = rows.select("query_id", F.lit(None).cast("string").alias("answer"), F.lit("mock").alias("provider"), F.lit("demo-extractive").alias("model"), *[F.lit(None).cast("int").alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")], F.lit(None).cast("string").alias("fallback_reason"))
    else:
        made = rows.select("query_id", "question", "prompt", "important").mapInPandas(run, kind)
    out = made.join(plain, "query_id").join(rows.select("query_id", "important"), "query_id")
    cost = estimate_usd(F.col("input_tokens"), F.col("output_tokens"), F.col("important"), settings)
    return out.select("query_id", F.coalesce("answer", "extracted").alias("answer"), *names[2:7], cost.alias("estimated_cost_usd"), "fallback_reason")
