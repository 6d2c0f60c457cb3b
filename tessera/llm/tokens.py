"""Token ids of whole texts with a public tokenizer, fast through a memory of chunks.

A text is cut where a cut can never change the result: between a letter or digit and a sign
that follows it, and before white space that follows something else.  Chunks met before are
looked up, new ones go through the tokenizer: a single word straight to its merge model,
anything else through all its steps.  Texts with characters whose class could differ between
the two regular expression engines, or with a special token's string, and all texts of a
tokenizer that is not a plain byte-level one, go through the tokenizer whole.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Sequence
from operator import itemgetter
from pathlib import Path

import numpy as np

from tessera.llm.common import worker_copy

BYTE_BPE = "byte_bpe_50k.json"
END_ID = 2
MOST_CHUNKS = 700_000
# The first alternative only saves time: all letters up to U+024F, and a cut before a digit is a cut between words.
CHUNK = re.compile(r" ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|\s*+[^\W_]+|\s*+\S+|\s+")
WHOLE = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ]")


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[int, int]:
    """Byte-level models write a printable byte as itself and the others as U+0100 and on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class Encoder(dict):
    """Maps chunks to their ids (little-endian unsigned 32-bit); learns a chunk when it is first asked for."""

    def __init__(self, path: str, most_chunks: int = MOST_CHUNKS):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most_chunks = most_chunks
        parts = json.loads(Path(path).read_text())
        steps = parts.get("pre_tokenizer") or {}
        self.plain = (
            steps.get("type") == "ByteLevel" and not steps.get("add_prefix_space") and steps.get("use_regex", True)
            and parts.get("normalizer") is None and parts["model"].get("type") == "BPE"
        )
        self.merge, self.characters = self.tokenizer.model.tokenize, byte_characters()
        self.space = chr(self.characters[0x20])

    def __missing__(self, chunk: str) -> bytes:
        spaced = chunk[0] == " "
        word = chunk[1:] if spaced else chunk
        if word.isalpha():  # one word, which nothing else would split
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.characters)
            found = [t.id for t in self.merge(self.space + shown if spaced else shown)]
        else:
            found = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        ids = self[chunk] = array("I", found).tobytes()
        return ids

    def ids(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; a missing text is empty."""
        if not text:
            return b""
        if not self.plain or WHOLE.search(text) or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) > self.most_chunks:
            self.clear()
        found = CHUNK.findall(text)
        return b"".join(itemgetter(*found)(self)) if len(found) > 1 else self[found[0]]

    def closed(self, texts: Sequence[str | None], end_id: int = END_ID) -> list[np.ndarray]:
        """Ids of each text with the end id after it."""
        end = array("I", [end_id]).tobytes()
        return [np.frombuffer(self.ids(t) + end, "<u4") for t in texts]


def encoder(path: str) -> Encoder:
    """The encoder of a file, kept by each Python worker from task to task."""
    return worker_copy(f"encoder {path}", lambda: Encoder(path))


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)
