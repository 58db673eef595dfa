"""Pluggable recognisers: image to text, opened once per task.

A recogniser is made by name from a registry; the factory and its settings
travel in the closure, so a plugin module only has to be importable by the
workers. ``table`` reads answers from a table of its own settings and serves
tests and replays; ``http`` asks a server with a chat interface.
"""

from __future__ import annotations

import json
import os
import random
import time
import urllib.error
import urllib.request
from base64 import b64encode
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalar import FALLBACK_ROLES, FIRST_PROMPT, SECOND_PROMPT
from .raster.kernels import pixel_hash, png

#: Requests after which a recogniser is opened anew.
REQUEST_BUDGET = 200
# Attempts and waits of a retried request, in seconds.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, LONGEST_HEADER = 4, 1.0, 15.0, 45.0
# Sampling of the recogniser's requests.
SAMPLING = {"temperature": 0.0, "top_k": 40, "top_p": 0.95, "min_p": 0.05, "presence_penalty": 0.0, "frequency_penalty": 0.0, "repeat_penalty": 1.0}


@dataclass(frozen=True)
class Answer:
    text: str
    finish_reason: str = "stop"
    tokens: int | None = None


class Recogniser(Protocol):
    """What a plugin offers. ``recognise`` may raise ``Retryable``."""

    def recognise(self, pixels: np.ndarray, prompt: str) -> Answer: ...

    def close(self) -> None: ...


class Retryable(RuntimeError):
    """A failure that may pass; ``after`` are the seconds the server asks to wait."""

    def __init__(self, reason: str, after: float | None = None):
        super().__init__(reason)
        self.after = None if after is None else min(after, LONGEST_HEADER)


@dataclass(frozen=True)
class Settings:
    """How to make a recogniser: its registered name, role, prompt and options."""

    name: str
    role: str = "ocr"
    prompt: str = FIRST_PROMPT
    options: dict = field(default_factory=dict)
    budget: int | None = REQUEST_BUDGET


_FACTORIES: dict[str, Callable[[dict], Recogniser]] = {}


def register(name: str, factory: Callable[[dict], Recogniser]) -> None:
    _FACTORIES[name] = factory


def create(settings: Settings) -> Recogniser:
    try:
        factory = _FACTORIES[settings.name]
    except KeyError:
        raise ValueError(f"unknown recogniser {settings.name!r}; there are {sorted(_FACTORIES)}") from None
    return factory(settings.options)


class TableRecogniser:
    """Answers by the hash of an image, as hexadecimal digits; others get ``missing``."""

    def __init__(self, options: dict):
        self.answers, self.missing = options.get("answers", {}), options.get("missing")

    def recognise(self, pixels: np.ndarray, prompt: str) -> Answer:
        key = pixel_hash(pixels).hex()
        found = self.answers.get(f"{key}:{prompt}", self.answers.get(key, key if self.missing is None else self.missing))
        return found if isinstance(found, Answer) else Answer(str(found))

    def close(self) -> None:
        pass


def asked_wait(header: str | None, body: bytes = b"", now: float | None = None) -> float | None:
    """Seconds a server asks to wait, by its header (seconds or a date) or else its error's details; null if it asks for none."""
    header = (header or "").strip()
    try:
        return max(0.0, float(header))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(header).timestamp() - (time.time() if now is None else now))
    except (TypeError, ValueError):
        pass
    try:
        delays = [str(d["retryDelay"]).strip() for d in json.loads(body)["error"]["details"] if "retryDelay" in d]
    except (KeyError, TypeError, ValueError):
        return None
    for delay in delays:
        try:
            return max(0.0, float(delay.removesuffix("s")))
        except ValueError:
            continue
    return None


class HttpRecogniser:
    """Chat completions over HTTP with the image as a data URL."""

    def __init__(self, options: dict):
        self.url, self.most = options["url"], int(options.get("max_new_tokens", 256))
        self.timeout = float(options.get("timeout", 60))
        self.sampling = SAMPLING | options.get("sampling", {})

    def recognise(self, pixels: np.ndarray, prompt: str) -> Answer:
        image = "data:image/png;base64," + b64encode(png(pixels)).decode()
        content = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": image}}]
        body = {"model": "default", "max_tokens": self.most, "messages": [{"role": "user", "content": content}]} | {k: v for k, v in self.sampling.items() if v is not None}
        found = self._sent(body)
        choice = found["choices"][0]
        return Answer(str(choice["message"]["content"]).strip(), choice.get("finish_reason"), found.get("usage", {}).get("completion_tokens"))

    def _sent(self, body: dict, headers: dict | None = None) -> dict:
        """The server's answer to a JSON body; failures that may pass are ``Retryable``."""
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"} | (headers or {}))
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as response:
                return json.load(response)
        except urllib.error.HTTPError as e:
            if e.code in (408, 429) or e.code >= 500:
                raise Retryable(f"HTTP {e.code}", asked_wait(e.headers.get("Retry-After"), e.read())) from e
            raise
        except (urllib.error.URLError, TimeoutError) as e:
            raise Retryable(str(e)) from e

    def close(self) -> None:
        pass


class CloudRecogniser(HttpRecogniser):
    """A model behind an interface of contents and parts, with the image inline.

    The key is read by each worker from the environment variable ``key_env``
    names. Parts marked as thoughts are left out of the text.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.key_env, self.extra = options.get("key_env"), options.get("generation", {})

    def recognise(self, pixels: np.ndarray, prompt: str) -> Answer:
        image = {"inlineData": {"mimeType": "image/png", "data": b64encode(png(pixels)).decode()}}
        body = {"contents": [{"role": "user", "parts": [{"text": prompt}, image]}], "generationConfig": {"temperature": self.sampling["temperature"]} | self.extra}
        found = self._sent(body, {"x-api-key": os.environ[self.key_env]} if self.key_env else {})
        parts = [p for c in found.get("candidates", []) for p in (c.get("content") or {}).get("parts", []) if p.get("text")]
        reasons = [c.get("finishReason") for c in found.get("candidates", [])]
        return Answer("".join(p["text"] for p in parts if not p.get("thought")).strip(), "length" if "MAX_TOKENS" in reasons else "stop")


class InProcessRecogniser:
    """A vision-language model loaded by each task; needs packages that may be absent."""

    def __init__(self, options: dict):
        try:
            import torch
            from transformers import AutoModelForCausalLM, AutoProcessor
        except ImportError as e:
            raise RuntimeError("the in-process recogniser needs torch and transformers") from e
        self._torch = torch
        device = options.get("device", "auto")
        self._device = device if device != "auto" else "cuda" if torch.cuda.is_available() else "cpu"
        where, local = options["model"], options.get("local_files_only", True)
        self._processor = AutoProcessor.from_pretrained(where, local_files_only=local)
        self._model = AutoModelForCausalLM.from_pretrained(where, local_files_only=local).to(self._device).eval()
        self._most = int(options.get("max_new_tokens", 256))

    def recognise(self, pixels: np.ndarray, prompt: str) -> Answer:
        inputs = self._processor(images=np.repeat(pixels[:, :, None], 3, axis=2), text=prompt, return_tensors="pt").to(self._device)
        with self._torch.inference_mode():
            ids = self._model.generate(**inputs, max_new_tokens=self._most, do_sample=False)[0, inputs["input_ids"].shape[1] :]
        return Answer(self._processor.decode(ids, skip_special_tokens=True).strip(), "length" if len(ids) >= self._most else "stop", len(ids))

    def close(self) -> None:
        self._model = None


register("cloud", CloudRecogniser)
register("in-process", InProcessRecogniser)
register("table", TableRecogniser)
register("http", HttpRecogniser)


def retried(call: Callable[[], Answer], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep, draw: Callable[[float, float], float] = random.uniform) -> Answer:
    """The call's answer after up to ``attempts`` tries, with full jitter over doubling waits."""
    wait = FIRST_WAIT
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Retryable as e:
            if attempt == attempts:
                raise
            sleep(min(LONGEST_WAIT, max(0.0, e.after)) if e.after is not None else draw(0.0, min(LONGEST_WAIT, wait)))
            wait = min(LONGEST_WAIT, wait * 2)
    raise AssertionError("unreachable")


class Session:
    """A task's recogniser: retries, asks again where an answer was cut off, opens anew after the budget."""

    def __init__(self, settings: Settings, factory: Callable[[dict], Recogniser] | None = None):
        self.settings = settings
        self._make = (lambda: factory(settings.options)) if factory else (lambda: create(settings))
        self._open: Recogniser | None = None
        self._asked = 0
        self.opened = 0

    def _ask(self, pixels: np.ndarray, prompt: str) -> Answer:
        if self._open is not None and self.settings.budget is not None and self._asked >= self.settings.budget:
            self.close()
        if self._open is None:
            self._open, self._asked = self._make(), 0
            self.opened += 1
        answer = retried(lambda: self._open.recognise(pixels, prompt))
        self._asked += 1
        return answer

    def text(self, pixels: np.ndarray) -> str:
        answer = self._ask(pixels, self.settings.prompt)
        if answer.finish_reason == "length" and self.settings.role in FALLBACK_ROLES and self.settings.prompt == FIRST_PROMPT:
            answer = self._ask(pixels, SECOND_PROMPT)
        return answer.text

    def close(self) -> None:
        if self._open is not None:
            self._open.close()
            self._open = None


def recognised(images: DataFrame, settings: Settings, keys: Sequence[str], parallel: int | None = None, strict: bool = False) -> DataFrame:
    """Texts of images (keys, width, height, pixels): keys, text, error.

    A row whose request fails for good keeps its place with an error; with
    ``strict`` it fails the job, and the tasks that have not begun do not ask.
    ``parallel`` bounds the tasks that ask at a time. Rows belong to their keys,
    whatever order the answers come in.
    """
    factory = _FACTORIES.get(settings.name)
    if factory is None:
        create(settings)
    rows = images.select(*keys, "width", "height", "pixels")
    if parallel:
        rows = rows.repartition(parallel)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = Session(settings, factory)
        try:
            for part in parts:
                texts, errors = [], []
                for width, height, pixels in zip(part["width"], part["height"], part["pixels"]):
                    try:
                        texts.append(session.text(np.frombuffer(pixels, dtype=np.uint8).reshape(height, width)))
                        errors.append("")
                    except Exception as e:  # noqa: BLE001 - any failure of a plugin belongs to its row
                        if strict:
                            raise
                        texts.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield part[list(keys)].assign(text=texts, error=errors)
        finally:
            session.close()

    return rows.mapInPandas(run, f"{ddl}, text string, error string")


def with_cache(requests: DataFrame, cache: DataFrame, key: str, answer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Answers of all requests, and those not in the cache yet, each key asked once.

    ``answer`` takes requests with different keys and adds ``text``. Keep the
    second table to add it to the cache.
    """
    once = requests.dropDuplicates([key])
    fresh = answer(once.join(cache.select(key), key, "left_anti")).select(key, "text")
    known = cache.select(key, "text").unionByName(fresh)
    return requests.join(known, key, "left"), fresh.where(F.col("text").isNotNull())
