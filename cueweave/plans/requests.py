"""Requests and their validation, done before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from ..operators.timeline import POLICIES
from ..recognizers import Settings

ENGINES = ("server", "in-process", "table")
MODES = ("default", "fast")
DETECTOR_MODES = ("default", "wider")
CORRECTORS = ("off", "local", "cloud")


class RequestError(ValueError):
    """A request that contradicts itself."""


def one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
    """A trimmed, lower-case choice among ``allowed``."""
    chosen = value.strip().lower()
    if chosen not in allowed:
        raise RequestError(f"unknown {what} {value!r}; there are {', '.join(allowed)}")
    return chosen


@dataclass(frozen=True)
class ConvertRequest:
    input_sup: str
    output_srt: str
    engine: str = "table"
    device: str = "auto"
    ocr_mode: str = "default"
    recogniser: Settings = Settings("table")
    fast_recogniser: Settings | None = None
    detector: Settings | None = None
    detector_output: str | None = None
    detector_mode: str = "default"
    family_addon: bool = False
    corrector: str = "off"
    corrector_settings: Settings | None = None
    corrector_output: str | None = None
    mask_aids: bool = False
    max_items: int | None = None
    max_new_tokens: int = 256
    srt_policy: str = "safe"
    compat_times: bool = True

    def checked(self) -> ConvertRequest:
        """The request with its choices in order, or an error that names the first contradiction."""
        engine, mode = one_of(self.engine, ENGINES, "engine"), one_of(self.ocr_mode, MODES, "mode")
        detector, corrector = one_of(self.detector_mode, DETECTOR_MODES, "detector mode"), one_of(self.corrector, CORRECTORS, "corrector")
        policy = one_of(self.srt_policy, POLICIES, "srt policy")
        reads_twice = self.detector_output is not None or corrector != "off"
        rules = [
            (self.max_items is not None and self.max_items <= 0, "max_items must be positive"),
            (self.max_new_tokens <= 0, "max_new_tokens must be positive"),
            (self.device != "auto" and engine != "in-process", "device is only for the in-process engine"),
            (reads_twice and engine == "in-process", "detector and corrector need another engine than in-process"),
            (reads_twice and mode != "default", "detector and corrector need the default mode"),
            (detector != "default" and not reads_twice, "a detector mode needs a detector output or a corrector"),
            (self.family_addon and not reads_twice, "the family add-on needs a detector output or a corrector"),
            (corrector == "off" and self.corrector_output is not None, "a corrector output needs a corrector"),
            (corrector != "off" and self.corrector_settings is None, "a corrector needs its settings"),
        ]
        for broken, why in rules:
            if broken:
                raise RequestError(why)
        distinct_paths(input_sup=self.input_sup, output_srt=self.output_srt, detector_output=self.detector_output, corrector_output=self.corrector_output)
        from dataclasses import replace

        return replace(self, engine=engine, ocr_mode=mode, detector_mode=detector, corrector=corrector, srt_policy=policy)


def distinct_paths(**paths: str | None) -> None:
    """No two of the paths may be the same."""
    seen: dict[Path, str] = {}
    for name, path in paths.items():
        if path is None:
            continue
        other = seen.setdefault(Path(path).absolute(), name)
        if other != name:
            raise RequestError(f"{other} and {name} must differ")
