"""Token ids by a public tokenizer file, with a bounded cache of white-space-free chunks."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import tiktoken
import tokenizers

#: Distinct chunks that a worker holds before it starts its cache anew.
CACHED_CHUNKS = 600_000

# The pre-tokenizer pattern and suffix of the files that the merge table below reproduces.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SUFFIX = "</w>"
#: A byte that UTF-8 never uses stands for the suffix.
END = b"\xff"
#: Chunks that pattern, NFC and lower-casing treat alike in every Unicode version, and what the pattern makes of them.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_of_sign() -> dict[str, int]:
    """The printable sign that stands for each byte in byte-level vocabularies: itself, or the next sign from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_table(path: str):
    """A function from a word's bytes and ``END`` to its ids, or None for files of another kind.

    Ids of such a file are in the order of its merges, with each byte's suffixed
    form before all merges, so the file's merges are those of a rank table in which
    ``END`` is one more byte.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, steps = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [])
    kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    if (model["type"], model.get("end_of_word_suffix"), kinds) != ("BPE", SUFFIX, ["NFC", "Replace", "Lowercase"]) or not steps or steps[0].get("pattern", {}).get("Regex") != WORD_PATTERN:
        return None
    byte, added = _byte_of_sign(), {x["content"] for x in spec["added_tokens"]}
    ranks = {}
    for token, rank in model["vocab"].items():
        if token not in added:
            ended = token.endswith(SUFFIX) and token != SUFFIX
            ranks[bytes(byte[c] for c in (token[: -len(SUFFIX)] if ended else token)) + END * ended] = rank
    if any(bytes([b]) not in ranks or bytes([b]) + END not in ranks for b in range(255)):
        return None
    ranks.setdefault(END, len(model["vocab"]))
    return tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class ChunkTokenizer(dict):
    """Encodes texts as the tokenizer file does, for pre-tokenizers that no match of which crosses white space.

    A text is cut at ASCII white space, which such a tokenizer drops, and each
    distinct chunk is encoded once: by the rank table where the chunk is plain and
    holds no added token, by the tokenizer itself otherwise. Where an added token of
    the file can reach over white space, texts are encoded whole. As a mapping it
    holds the chunks seen, each with its ids as little-endian unsigned 32-bit numbers.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.merge = merge_table(path)
        with open(path, encoding="utf-8") as file:
            added = [x for x in json.load(file)["added_tokens"] if x["content"]]
        self.added = re.compile("|".join(re.escape(x["content"]) for x in added) or r"(?!)", re.I)
        self.whole = any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) for x in added)

    def __missing__(self, chunk: bytes) -> bytes:
        text, merge = chunk.decode(), self.merge
        if merge is not None and PLAIN.fullmatch(text) and not self.added.search(text):
            words = PLAIN_WORDS.findall(text.lower())
            run = merge(words[0].encode() + END) if len(words) == 1 else [i for word in words for i in merge(word.encode() + END)]
        else:
            run = self.tokenizer.encode(text, add_special_tokens=False).ids
        self[chunk] = out = np.array(run, "<u4").tobytes()
        return out

    def encode(self, text: bytes) -> np.ndarray:
        """uint32 ids of a text in UTF-8."""
        if self.whole:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4")
        if len(self) > CACHED_CHUNKS:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), "<u4")


@functools.cache
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer for all tasks of a worker."""
    return ChunkTokenizer(path)
