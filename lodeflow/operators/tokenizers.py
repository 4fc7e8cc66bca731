"""What a tokenizer must offer, a byte tokenizer that needs no file, and encoding as an Arrow stage."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.operators.batches import sized_slices, spread, text_slices
from lodeflow.schemas import SPECIAL_TOKENS


class Tokenizer(Protocol):
    """Picklable. ``encode_offsets`` gives ids and, of each, first and last + 1 code point."""

    eos_id: int

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...

    def encode_offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]: ...


class ByteTokenizer:
    """Special tokens are ids 0 to 8, end of text first; byte b is id b + 9."""

    def __init__(self) -> None:
        self.ids = {t: i for i, t in enumerate(SPECIAL_TOKENS.values())}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.eos_id = 0
        self.shift = len(self.ids)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.ids)) + ")")

    @property
    def vocab_size(self) -> int:
        return 256 + self.shift

    def encode_offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        ids, offsets, at = [], [], 0
        for part in self.cut.split(text):
            if part in self.ids:
                ids.append(self.ids[part])
                offsets.append((at, at + len(part)))
            elif part:
                data = np.frombuffer(part.encode("utf-8", "replace"), np.uint8)
                own = np.cumsum((data & 0xC0) != 0x80) - 1 + at  # each byte's code point
                ids += (data.astype(np.int32) + self.shift).tolist()
                offsets += zip(own.tolist(), (own + 1).tolist())
            at += len(part)
        return ids, offsets

    def encode_array(self, text: str) -> np.ndarray:
        parts = []
        for part in self.cut.split(text) if "<" in text else [text]:
            if part in self.ids:
                parts.append(np.array([self.ids[part]], np.int32))
            elif part:
                parts.append(np.frombuffer(part.encode("utf-8", "replace"), np.uint8).astype(np.int32) + np.int32(self.shift))
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def encode(self, text: str) -> list[int]:
        return self.encode_array(text).tolist()

    def decode(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            if i >= self.shift:
                run.append(i - self.shift)
            else:
                out += [run.decode("utf-8", "replace"), self.tokens[i]]
                run = bytearray()
        return "".join([*out, run.decode("utf-8", "replace")])


class FileTokenizer:
    """A ``tokenizer.json`` with the nine special tokens; loaded once in each worker."""

    def __init__(self, path: str) -> None:
        self.path = path
        self._tok = None
        missing = [t for t in SPECIAL_TOKENS.values() if self.tok.token_to_id(t) is None]
        if missing:
            raise ValueError(f"the vocabulary lacks {missing}")
        self.eos_id = self.tok.token_to_id(SPECIAL_TOKENS["eos"])

    @property
    def tok(self):
        if self._tok is None:
            from tokenizers import Tokenizer as Loaded

            self._tok = Loaded.from_file(self.path)
        return self._tok

    def __getstate__(self) -> dict:
        return {"path": self.path, "eos_id": self.eos_id, "_tok": None}

    def encode(self, text: str) -> list[int]:
        return self.tok.encode(text).ids

    def decode(self, ids: list[int]) -> str:
        return self.tok.decode(ids)

    def encode_offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        e = self.tok.encode(text)
        return e.ids, e.offsets


def profile_vocabulary(path: str) -> dict:
    """Sizes and parts of a ``tokenizer.json``, and of the ``tokenizer_config.json`` beside it, if there is one."""
    file = Path(path)
    data = json.loads(file.read_text(encoding="utf-8"))
    model = data.get("model", {})
    kept = {k: data.get(k) for k in ("added_tokens", "pre_tokenizer", "post_processor", "normalizer", "decoder")}
    found = {"vocab_size": len(model.get("vocab", {})), "merges": len(model.get("merges", [])), "model_type": model.get("type")} | kept
    beside = file.with_name("tokenizer_config.json")
    config = json.loads(beside.read_text(encoding="utf-8")) if beside.exists() else {}
    special = {k: v for k, v in config.items() if k.endswith("_token")}
    return found | {"config_keys": sorted(config), "special_tokens": special, "chat_template": config.get("chat_template")}


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32)))


def encode_texts(table: DataFrame, tokenizer: Tokenizer, id_col: str = "id", text_col: str = "clean") -> DataFrame:
    """(``id``, ``n``, ``ids`` ARRAY<INT>): number of tokens and the tokens. NULL has none."""
    sent = table.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = sent.value
        encode = getattr(tok, "encode_array", None) or (lambda t: np.array(tok.encode(t), np.int32))
        for batch in batches:
            for part in text_slices(batch, "text"):
                arrays = [encode(t) if t is not None else np.zeros(0, np.int32) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x) for x in arrays], pa.int32()), _lists(arrays)], ["id", "n", "ids"])

    return spread(table.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, "id BIGINT, n INT, ids ARRAY<INT>")


def decode_ids(table: DataFrame, tokenizer: Tokenizer, id_col: str = "id", ids_col: str = "ids", id_type: str = "BIGINT") -> DataFrame:
    """(``id``, ``text``)."""
    sent = table.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized_slices(batch, ["ids"]):
                texts = [sent.value.decode(x) if x is not None else None for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return table.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {id_type}, text STRING")
