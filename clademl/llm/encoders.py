"""Tokenizers of the public vocabulary files, as used inside tasks."""

from __future__ import annotations

import json
from array import array
from functools import cached_property


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return out


class ByteBpe:
    """Ids of a byte-level BPE file of the ``tokenizers`` library.

    Texts go through ``tiktoken`` over the same vocabulary (the same ids, some four times as fast as
    ``tokenizers`` here; the tests hold the two against each other). Texts with special strings, and
    any that ``tiktoken`` refuses, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_alphabet()
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = spec["model"]["vocab"]
        self.size = 1 + max(*vocab.values(), *(t["id"] for t in spec["added_tokens"]))
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, without added special tokens."""
        if not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # its pattern engine gives up on some very long runs
                pass
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


class PieceModel:
    """Ids of a ``sentencepiece`` model file, without begin or end ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)
