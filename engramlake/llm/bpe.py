"""Token ids of whole texts, fast: the byte-pair merges of a byte-level tokenizer file as ranks."""

from __future__ import annotations

import json

import numpy as np

from engramlake.llm.token_counts import PATTERN


def _bytes_of_marks() -> dict[str, int]:
    """Byte-level BPE writes bytes as printable characters: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ids:
    """``Tokenizer.encode(text, add_special_tokens=False).ids`` for byte-level BPE files whose ids follow their merges.

    Any other file is encoded by the tokenizers library itself.
    """

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        byte_level = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added) and not model.get("ignore_merges") and not model.get("dropout")
        self.encoding = None
        if byte_level and plain and model.get("type") == "BPE":
            import tiktoken

            marks = _bytes_of_marks()
            special = {t["content"]: t["id"] for t in added}
            vocab = {bytes(marks[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
            pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            made = [model["vocab"][a + b] for a, b in pairs]
            if made == sorted(made):  # then the rank of a merge is the id it makes
                self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens=special)
        if self.encoding is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(tokenizer_json)

    def __call__(self, text: str) -> np.ndarray:
        if self.encoding is not None:
            return self.encoding.encode_to_numpy(text, allowed_special="all").astype(np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
