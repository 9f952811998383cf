"""Byte-level BPE from a tokenizer file, as the tokenizers library reads it: splitting, ids and counts."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Fixed value: the split pattern of the ByteLevel pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies print each byte as one visible character: itself where visible, else from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """A ByteLevel BPE file without normaliser. `special`: added tokens, found in a text before it is split."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["type"] != "BPE":
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        of = _byte_of_char()
        ranks = {bytes(of[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in self.special}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)
        self.pieces = regex.compile(SPLIT).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).split if self.special else None

    def ids(self, text: str) -> np.ndarray:
        """The library's ids. The fast encoder applies the same merges of the same file; where it gives up, the library does it."""
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # noqa: BLE001  a panic in its matcher isn't an Exception
            if type(e).__name__ != "PanicException":
                raise
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many added tokens stand between them."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.pieces(text), 0
        parts = self.cut(text)
        return [p for part in parts for p in self.pieces(part)], len(parts) - 1

    def n_pieces(self, pre_tokens: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(pre_tokens, add_special_tokens=False)]


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One per Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteBpe(path)
