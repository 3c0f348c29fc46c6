"""Token ids of a byte-level BPE, cached by word."""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import lru_cache

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
ODD_SPACE = re.compile(r"[^\S \n]")
CACHED = 600_000


class WordEncoder(dict):
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The vocabulary splits a text before each single space that a visible character follows, and
    round a single line feed between visible characters. Between such cuts the ids of a stretch do not
    depend on its neighbours, so each distinct stretch is encoded once. Lines with any other white
    space are encoded whole. Strings of special tokens in a text are ordinary text.

    Where the same vocabulary lies beside the file as ranks (.tiktoken), single stretches go through those:
    the ids are the same, and a short call costs less."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.one = lambda piece: self.tokenizer.encode(piece, add_special_tokens=False).ids
        if os.path.exists(ranks := path.removesuffix(".json") + ".tiktoken"):
            with open(ranks, "rb") as f:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.one = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known,
                                         special_tokens={})._core_bpe.encode_ordinary

    def __missing__(self, piece: str) -> bytes:
        self[piece] = out = array("I", self.one(piece)).tobytes()
        return out

    def encode(self, text: str) -> bytes:
        if len(self) > CACHED:
            self.clear()
        if ODD_SPACE.search(text):
            return self._whole(text)
        lines = text.split("\n")
        if "" in lines or any(x[0] == " " or x[-1] == " " for x in lines) or "  " in text:
            return self._whole(text) if text else b""
        out = []
        for i, line in enumerate(lines):
            if i:
                out.append(self["\n"])
            first, *rest = line.split(" ")
            out.append(self[first])
            out += map(self.__getitem__, map(" ".__add__, rest))
        return b"".join(out)

    def _whole(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)


@lru_cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def default_path() -> str:
    return public_tokenizers.path(VOCABULARY)
