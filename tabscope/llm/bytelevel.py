"""Encoding with a byte-level BPE vocabulary file, exactly as the tokenizers library does.

Where the file describes the usual byte-level scheme (its fixed pattern, no
normaliser, ids in the order of merges), a second library with the same
merges does the work several times faster. Texts it refuses, such as a
million spaces in a row, and files of other schemes go through the tokenizers
library itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# Fixed value: how byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_names() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: visible ones themselves, the others from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {chr(b): b for b in visible}
    hidden = (b for b in range(256) if b not in set(visible))
    return names | {chr(256 + place): b for place, b in enumerate(hidden)}


class ByteCodec:
    """Ids of texts, and the bytes of each id, by one vocabulary file.

    With ``specials`` the strings of special tokens become those tokens, as
    is the library's habit; without, they are ordinary text.
    """

    def __init__(self, vocabulary: str, specials: bool):
        self.library = Tokenizer.from_file(vocabulary)
        self.library.encode_special_tokens = not specials
        with open(vocabulary, encoding="utf-8") as file:
            described = json.load(file)
        names = byte_names()
        added = {token["content"]: token["id"] for token in described.get("added_tokens", [])}
        ranks = {bytes(names[c] for c in piece): i for piece, i in described["model"]["vocab"].items() if piece not in added}
        self.raw = [b""] * (1 + max([*ranks.values(), *added.values()]))
        for raw, i in [*ranks.items(), *((content.encode(), i) for content, i in added.items())]:
            self.raw[i] = raw
        self.fast = None
        if self._usual(described, ranks):
            self.fast = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added if specials else {})

    @staticmethod
    def _usual(described: dict, ranks: dict[bytes, int]) -> bool:
        cut, model = described.get("pre_tokenizer") or {}, described["model"]
        by_rank = sorted(ranks.values())
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        whole = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        special = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in described.get("added_tokens", []))
        names = {b: c for c, b in byte_names().items()}
        merged = [described["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model.get("merges", [])]
        return (
            model.get("type") == "BPE"
            and plain
            and whole
            and special
            and not described.get("normalizer")
            and by_rank == list(range(len(by_rank)))
            and all(names[b] in model["vocab"] for b in range(256))
            and merged == sorted(set(merged))
        )

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
            except ValueError:
                pass  # the faster library's pattern engine has a bound on runs of white space
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")


@lru_cache(2)
def byte_codec(vocabulary: str, specials: bool) -> ByteCodec:
    """One codec per Python worker, vocabulary and way with special tokens."""
    return ByteCodec(vocabulary, specials)
