"""Token ids of whole texts by a given tokenizer file, with pieces of text encoded once."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from importlib import metadata
from pathlib import Path

import numpy as np
import pyarrow as pa

from corpusbundle.llm.spans import chunks, distinct, ragged, runs, sums

#: Pieces whose ids a task remembers; it starts afresh beyond that.
REMEMBERED = 200_000


def version_of(path: str) -> str:
    """Digest of the tokenizer file and of the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    stamp = f"{library} {metadata.version(library)}\n".encode()
    return hashlib.sha256(stamp + Path(path).read_bytes()).hexdigest()


def _cuts_before_space(spec: dict) -> bool:
    """Whether ids of a text are those of its ``chunks``, one after the other.

    True for two forms of pre-tokenizer: byte level with its own pattern, and a split
    into words that leaves white space out. Neither has a token that goes on from a
    character other than white space into white space. Anything else is not cut.
    """
    if spec.get("post_processor") or spec.get("truncation") or spec.get("padding"):
        return False
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        return False
    if any(c.isspace() for t in spec["added_tokens"] for c in t["content"]):
        return False
    pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel":
        return normal is None and pre.get("use_regex") is True and not pre.get("add_prefix_space")
    steps = pre.get("pretokenizers") or [{}]
    split = steps[0]
    word = {
        "type": "Split",
        "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
        "behavior": "Removed",
        "invert": True,
    }
    plain = [n.get("type") for n in (normal or {}).get("normalizers", [])]
    return (
        split == word
        and [s.get("type") for s in steps[1:]] == ["ByteLevel"]
        and not steps[1].get("use_regex", True)
        and not steps[1].get("add_prefix_space")
        and set(plain) <= {"NFC", "Replace", "Lowercase"}
    )


#: Fixed: the pattern of byte-level pre-tokenizers.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ids by the bytes of their token, if ids after the single bytes follow the order of merges.

    Such a vocabulary can be encoded from ranks alone. None for any other.
    """
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer"):
        return None
    if any(model.get(k) for k in ("end_of_word_suffix", "continuing_subword_prefix", "dropout", "ignore_merges")):
        return None
    vocab, merges = model["vocab"], model["merges"]
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    if any(vocab.get(m) != 256 + i for i, m in enumerate(joined)):
        return None
    # Fixed rule of byte-level vocabularies: printable Latin-1 bytes stand for themselves,
    # the others follow from U+0100 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}


class Vocabulary:
    """A tokenizer to send to tasks: it carries the file's content and loads it on first use."""

    def __init__(self, path: str):
        self.content = Path(path).read_bytes()
        self.is_model = path.endswith(".model")
        self.cut = not self.is_model and _cuts_before_space(json.loads(self.content))

    def _load(self):
        if self.is_model:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=self.content)
            return lambda texts: model.encode(texts, num_threads=1)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(self.content.decode())
        spec = json.loads(self.content)

        def encode(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]

        ranks = _byte_ranks(spec)
        if ranks is None:
            return encode
        import tiktoken

        quick = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        special = [t["content"] for t in spec["added_tokens"]]

        def encode_by_rank(texts: list[str]) -> list[list[int]]:
            odd = [any(s in t for s in special) for t in texts]
            slow = iter(encode([t for t, o in zip(texts, odd) if o]))
            return [next(slow) if o else quick.encode_ordinary(t) for t, o in zip(texts, odd)]

        return encode_by_rank

    def encoder(self) -> Encoder:
        return Encoder(self._load(), self.cut)


class Encoder:
    """Encodes columns of texts inside one task."""

    def __init__(self, encode, cut: bool):
        self.encode, self.cut = encode, cut
        self.known: dict[bytes, int] = {}
        self.flat: list[np.ndarray] = []
        self._table: tuple[np.ndarray, np.ndarray] | None = None
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of the pieces in the table of ids."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED and self.known:
            self.known, new = {}, pieces
            self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.ids = np.zeros(0, np.uint32)
        if new:
            found = self.encode([p.decode("utf-8", "replace") for p in new])
            length = np.fromiter(map(len, found), np.int64, len(found))
            start = len(self.ids) + np.cumsum(length) - length
            own = np.fromiter((i for ids in found for i in ids), np.uint32, int(length.sum()))
            self.ids = np.concatenate([self.ids, own])
            self.known.update(zip(new, range(len(self.start), len(self.start) + len(new))))
            self.start = np.concatenate([self.start, start])
            self.length = np.concatenate([self.length, length])
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def _pieces(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each run of texts: the number of each piece, and where each text's pieces begin."""
        for texts in runs(column):
            spans = chunks(texts)
            codes, first = distinct(texts.data, spans)
            raw = texts.data.tobytes()
            pieces = [raw[a:b] for a, b in zip(spans.start[first].tolist(), spans.end[first].tolist())]
            yield self._learn(pieces)[codes], spans.at

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        if not self.cut:
            return np.concatenate([np.zeros(0, np.int64), *(np.diff(at) for _, at in self.texts(column))])
        parts = [sums(self.length[numbers], at) for numbers, at in self._pieces(column)]
        return np.concatenate([np.zeros(0, np.int64), *parts])

    def texts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each run of texts: their ids one after the other, and where each text's begin."""
        if not self.cut:
            for texts in runs(column):
                raw, edges = texts.data.tobytes(), texts.offsets.tolist()
                found = self.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:])])
                at = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
                yield np.fromiter((i for f in found for i in f), np.uint32, int(at[-1])), at
            return
        for numbers, pieces_at in self._pieces(column):
            length = self.length[numbers]
            at = np.concatenate([[0], np.cumsum(length)])[pieces_at]
            yield self.ids[ragged(self.start[numbers], length)], at
