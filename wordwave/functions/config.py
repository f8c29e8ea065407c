"""Configurations: quantity codes, weighting schemes, vocabulary sizes, search grids."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

#: Two-letter codes as they stand in group names (fixed values).
GROUP_CODES = {"Me": "mean", "Tr": "trend", "St": "std", "Va": "var", "Mm": "min_max", "Mn": "min", "Mx": "max", "Co": "count"}
_TO_CODE = {v: k for k, v in GROUP_CODES.items()}

#: Coarser taxonomy of the class codes (fixed values).
MERGED_CLASSES = {
    6: "Single microlens",
    15: "TDE",
    16: "Short period VS",
    42: "SN",
    52: "SN",
    53: "Short period VS",
    62: "SN",
    64: "SN",
    65: "M-dwarf",
    67: "SN",
    88: "AGN",
    90: "SN",
    92: "Short period VS",
    95: "SN",
    99: "Unknown",
    991: "Unknown",
    992: "Unknown",
    993: "Unknown",
    994: "Unknown",
    995: "Unknown",
}
#: Numbers of the merged classes (fixed values).
MERGED_NUMBERS = {"Single microlens": 1, "TDE": 2, "Short period VS": 3, "SN": 4, "M-dwarf": 5, "AGN": 6, "Unknown": 99}


def quantities_of(code: str) -> list[list[str]]:
    """``"(TrMm-MmMn)"`` -> ``[["trend", "min_max"], ["min_max", "min"]]``."""
    return [[GROUP_CODES[c] for c in re.findall("..", group)] for group in code.strip("()").split("-") if group]


def code_of(groups: list[list[str]]) -> str:
    """The inverse of :func:`quantities_of`."""
    return "(" + "-".join("".join(_TO_CODE[q] for q in group) for group in groups) + ")"


def scheme_code(sublinear: bool, idf: bool, norm: bool) -> str:
    """SMART notation: l or n (term), t or n (document), c or n (norm)."""
    return ("l" if sublinear else "n") + ("t" if idf else "n") + ("c" if norm else "n")


def scheme_of(code: str) -> tuple[bool, bool, bool]:
    return code[0] == "l", code[1] == "t", code[2] == "c"


def vocabulary_size(alphabet: int, word_length: int, special: bool = True) -> int:
    """Words over an alphabet, with or without the special character."""
    return (alphabet + int(special)) ** word_length


def is_new_combination(known: list[tuple], candidate: tuple) -> bool:
    """Whether no known combination has the same members, in any order."""
    return all(frozenset(k) != frozenset(candidate) for k in known)


def log_grid(low: float, high: float, n: int) -> list[float]:
    """``n`` window widths, evenly spaced in the logarithm, rounded to three digits."""
    if n == 1:
        return [round(low, 3)]
    ratio = (high / low) ** (1 / (n - 1))
    return [round(low * ratio**k, 3) for k in range(n)]


@dataclass(frozen=True)
class Config:
    """Parameters of a representation and its compaction."""

    alphabet: int = 4
    quantities: tuple[tuple[str, ...], ...] = (("min_max",),)
    resolution: tuple[tuple[float, int], ...] = ((10.0, 1),)
    budget: int = 100
    method: str = "LSA"
    scheme: str = "ltc"
    drop_zero_variance: bool = True
    segmentation: str = "effective"
    num_reduction: bool = True
    max_dropped: float = 0.05
    alphabets: dict = field(default_factory=dict)

    def alphabet_of(self, quantity: str) -> int:
        """Bins of a quantity: its own where given, else the common ones."""
        return self.alphabets.get(quantity, self.alphabet)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=1))

    @staticmethod
    def load(path: str) -> Config:
        raw = json.loads(Path(path).read_text())
        known = set(Config.__dataclass_fields__)
        if extra := set(raw) - known:
            raise ValueError(f"unknown settings: {sorted(extra)}")
        raw["quantities"] = tuple(tuple(q) for q in raw.get("quantities", ()))
        raw["resolution"] = tuple((float(w), int(l)) for w, l in raw.get("resolution", ()))
        return Config(**raw)
