"""Token ids by a public tokenizer file, inside tasks.

``encoder(path)`` serves a byte-level BPE ``tokenizers`` file.  The ids come
from ``tiktoken`` over the file's own vocabulary, which is several times faster
and gives the same ids (held by a test).  To ``tokenizers`` itself go texts that
contain one of the file's added tokens, which it finds before it splits, and all
texts if the file asks for another split or model than ``tiktoken`` is set up for.
Texts of any length are encoded whole.  Nothing is trained and no file is copied.
"""

from __future__ import annotations

import json
from functools import lru_cache

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level files write for the 256 byte values: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_bytes(spec: dict) -> bool:
    """Whether a tokenizer file describes what ``tiktoken`` does with ``PATTERN``: no
    normaliser, byte-level split by the usual expression, plain BPE merges."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
            and not split.get("add_prefix_space") and model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix",
                                               "byte_fallback", "ignore_merges")))


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        self._exact = Tokenizer.from_file(path)
        self._exact.no_truncation()
        self._exact.no_padding()
        self._fast = None
        if not plain_bytes(spec):
            return
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                 if token not in self.added}
        self._fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks,
                                       special_tokens={})

    def ids(self, text: str | None) -> list[int]:
        """Ids of a whole text without special tokens; null is empty."""
        if not text:
            return []
        if self._fast is None or any(t in text for t in self.added):
            return self._exact.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path)
