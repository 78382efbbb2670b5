"""Language-model steps as DataFrame operators; the model itself is a protocol: token_logprobs(text) and perturb(text)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import kernels


def mask_spans(text: str | Column, rate: float = 0.15, size: int = 2, seed: int = 0) -> Column:
    """struct<masked, n>; null stays null."""
    out = T.StructType([T.StructField("masked", T.StringType()), T.StructField("n", T.IntegerType())])

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if t is None else kernels.mask_spans(t, rate, size, seed) for t in s], columns=["masked", "n"])

    return F.pandas_udf(run, out)(text)


def refill(masked: str | Column, generated: str | Column) -> Column:
    def run(m: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else kernels.refill(a, b or "") for a, b in zip(m, g)], dtype=object)

    return F.pandas_udf(run, T.StringType())(masked, generated)


class TransformersLM:
    """Causal model from the optional `transformers` package, loaded on first use in the worker."""

    def __init__(self, name: str = "gpt2-medium", max_tokens: int = 1024, infill: str | None = None):
        """infill: a span-filling model; variants of a text are then its refilled spans, not the text with words left out."""
        self.name, self.max_tokens, self.infill, self._parts, self._filler = name, max_tokens, infill, None, None

    def _load(self):
        if self._parts is None:
            from transformers import AutoModelForCausalLM, AutoTokenizer

            self._parts = AutoTokenizer.from_pretrained(self.name), AutoModelForCausalLM.from_pretrained(self.name).eval()
        return self._parts

    def token_logprobs(self, text: str) -> list[tuple[str, float, float]]:
        if not text.strip():
            return []
        import torch

        tok, model = self._load()
        ids = tok(text, return_tensors="pt")["input_ids"]
        out: list[tuple[str, float, float]] = []
        # windows that overlap by half: every token but the first is scored once, with at least half a window before it
        for begin, scored in windows(ids.shape[1], self.max_tokens):
            with torch.no_grad():
                logp = torch.log_softmax(model(ids[:, begin:begin + self.max_tokens]).logits[0, :-1], -1)[scored - begin - 1:]
            target = ids[0, scored:begin + self.max_tokens]
            own = logp.gather(1, target[:, None])
            rank = (logp > own).sum(1) + 1
            out += [(tok.decode([int(t)]), float(p), float(torch.log(r.double()))) for t, p, r in zip(target, own[:, 0], rank)]
        return out

    def perturb(self, text: str, n: int = 8) -> list[str]:
        if self.infill is None:
            return kernels.drop_words(text, n)
        return infilled(text, n, self._fill)

    def _fill(self, masked: str) -> str:
        if self._filler is None:
            from transformers import AutoModelForSeq2SeqLM, AutoTokenizer

            self._filler = AutoTokenizer.from_pretrained(self.infill), AutoModelForSeq2SeqLM.from_pretrained(self.infill).eval()
        tok, model = self._filler
        return tok.decode(model.generate(**tok(masked, return_tensors="pt"), do_sample=True, max_new_tokens=256)[0], skip_special_tokens=False)


def windows(n: int, size: int) -> list[tuple[int, int]]:
    """(where a window begins, the first token scored in it): together they score the tokens 1 to n - 1, each once."""
    out, done = [], 1
    begin = 0
    while done < n:
        out.append((begin, done))
        done = min(n, begin + size)
        begin = max(0, done - size // 2)
    return out


def infilled(text: str, n: int, fill: Callable[[str], str], rate: float = 0.15, size: int = 2) -> list[str]:
    """Variants of a text: some of its spans are masked, another draw each time, and filled again. Texts too short to mask give none."""
    out = []
    for seed in range(n):
        masked, holes = kernels.mask_spans(text, rate, size, seed)
        if holes:
            out.append(kernels.refill(masked, fill(masked)))
    return [x for x in out if x]
