"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from array import array


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class TextTokenizer:
    """ids(text): the ids, without special tokens added, as little-endian unsigned 32-bit integers.

    path: a byte-level BPE vocabulary of the tokenizers library. Where the same vocabulary lies beside it as ranks
    (.tiktoken), texts are encoded from those, which gives the same ids in a sixth of the time. Texts that hold the
    string of a special token always go through the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(x in text for x in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


_made: dict[str, TextTokenizer] = {}


def tokenizer(path: str) -> TextTokenizer:
    """One tokenizer a worker process and vocabulary."""
    if path not in _made:
        _made[path] = TextTokenizer(path)
    return _made[path]
