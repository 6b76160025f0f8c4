"""The settings of a run, as JSON or as options of a command line."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields

# Words for true and false.
WORDS = {True: "yes true t y 1", False: "no false f n 0"}


@dataclass
class Settings:
    """Hyper-parameters of corpus preparation."""

    length: int = 200
    vocabulary: int = 5000
    share: float = 0.05
    max_words: int = 10_000_000
    alphabet: str = "lt"
    seed: int = 42
    carry: bool = True
    taggers: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Settings:
        return cls(**json.loads(text))

    @classmethod
    def from_options(cls, **options: str) -> Settings:
        """Settings from strings, each read by the type of its field; unknown names and unreadable values are errors."""
        types = {f.name: f.type for f in fields(cls)}
        read = {"int": int, "float": float, "str": str, "bool": truth, "list[str]": addresses}
        return cls(**{k: read[types[k]](v) for k, v in options.items()})


def truth(word: str) -> bool:
    """What one of WORDS means, in any case and with blanks around it."""
    meant = [value for value, words in WORDS.items() if word.strip().casefold() in words.split()]
    if len(meant) != 1:
        raise ValueError(f"neither true nor false: {word!r}")
    return meant[0]


def addresses(*options: str) -> list[str]:
    """Everything between commas and white space in the options, in order; there must be something."""
    found = re.findall(r"[^\s,]+", ",".join(options))
    if not found:
        raise ValueError("an address is needed")
    return found
