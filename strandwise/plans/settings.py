"""What a run is set to, and its list of tasks."""

from __future__ import annotations

from dataclasses import dataclass, fields

from strandwise.sources.text import number_with_unit, settings, truth

#: Short names of task lists.
TASK_LISTS = {"all": "561234", "default": "5612", "best": "55661212"}


@dataclass(frozen=True)
class Settings:
    """Defaults that define results."""

    task: str = "best"
    trim: int = 2
    edge: int = 2
    min_mapq: int = 0
    penalty_short: float = 0.5
    penalty_long: float = 0.33
    least_share: float = 0.8
    region_gap: int = 5
    longest_region: int = 50
    observations: int = 50
    least_snp_count: int = 5
    snp_low: float = 0.34
    ploidy: int = 2
    insert_fold: int = 5
    window: int = 5_000_000
    overlap: int = 1_000_000
    stitch: int = 50
    read_type: str = "ont"
    sgs_depth: float = 100.0
    lgs_depth: float = 100.0
    uppercase: bool = False
    split: bool = False

    @classmethod
    def parse(cls, text: str) -> Settings:
        """From the text of a settings file; unknown keys are passed over."""
        given = settings(text)
        out = {}
        for f in fields(cls):
            if f.name in given:
                v = given[f.name]
                out[f.name] = {"int": number_with_unit, "float": float, "bool": truth}.get(str(f.type), str)(v)
        return cls(**out)

    def tasks(self, short: bool, long: bool) -> list[int]:
        """The tasks in order, without those whose reads are missing. 5 and 6 need long reads; 1, 2 and 4 short ones;
        3 needs short ones. Long-read tasks come before short-read tasks."""
        text = TASK_LISTS.get(self.task, self.task)
        if not text.isdigit() or set(text) - set("123456"):
            raise ValueError(f"no tasks: {self.task}")
        kept = [int(t) for t in text if (long if t in "56" else short)]
        kinds = [t in (5, 6) for t in kept]
        if kinds != sorted(kinds, reverse=True):
            raise ValueError("long-read tasks must come before short-read tasks")
        return kept


def option_value(options: str, flag: str) -> tuple[str | None, str]:
    """The value that follows a flag in a string of options, and the string without both."""
    words = options.split()
    if flag not in words:
        return None, options
    i = words.index(flag)
    return (words[i + 1] if i + 1 < len(words) else ""), " ".join(words[:i] + words[i + 2 :])
