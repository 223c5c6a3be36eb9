"""Text models behind one interface, run on partitions with bounded concurrency. The default works offline."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame

#: Requests in flight per task, and reply lengths asked for by purpose.
IN_FLIGHT = {"summary": 8, "flow": 8, "guide": 4}
REPLY_TOKENS = {"summary": 160, "guide": 900, "flow": 320}


@dataclass
class Offline:
    """A deterministic stand-in for a model: it repeats what it is told in the expected reply formats."""

    used: dict = field(default_factory=lambda: {"prompt": 0, "reply": 0, "calls": 0})

    def complete(self, system: str, prompt: str, max_tokens: int) -> str:
        first = next((x.strip() for x in prompt.splitlines() if x.strip()), "")
        mark = "NARRATION" if "NARRATION" in system else "SUMMARY" if "SUMMARY" in system else ""
        reply = f"{mark}: {first}\nQUERIES: what is {first} | where is {first} used | how does {first} work" if mark else f"- {first}"
        self.used["calls"] += 1
        self.used["prompt"] += (len(system) + len(prompt)) // 4
        self.used["reply"] += len(reply) // 4
        return reply


@dataclass
class Chat:
    """A model behind an endpoint of the usual chat-completion form: base URL, model, and a key where one is needed.

    Requests that fail with a server's error or a lost connection are tried again `tries` times; the tokens the endpoint reports are added up.
    """

    base_url: str
    model: str
    key: str | None = None
    timeout: float = 60.0
    tries: int = 3
    used: dict = field(default_factory=lambda: {"prompt": 0, "reply": 0, "calls": 0})

    def complete(self, system: str, prompt: str, max_tokens: int) -> str:
        body = {"model": self.model, "max_tokens": max_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        ask = urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), head)
        for left in reversed(range(self.tries)):
            try:
                with urllib.request.urlopen(ask, timeout=self.timeout) as reply:
                    said = json.load(reply)
                break
            except urllib.error.HTTPError as e:
                if e.code < 500 and e.code != 429 or not left:
                    raise
            except (urllib.error.URLError, TimeoutError):
                if not left:
                    raise
            time.sleep(0.2 * 2 ** (self.tries - left))
        used = said.get("usage") or {}
        self.used["calls"] += 1
        self.used["prompt"] += used.get("prompt_tokens", 0)
        self.used["reply"] += used.get("completion_tokens", 0)
        return said["choices"][0]["message"]["content"] or ""


def provider_of(model: str | None, base_url: str | None, key: str | None = None) -> Callable | None:
    """What makes a client in a task: offline, an endpoint, or none where no model is set. A model without an endpoint is an error."""
    if not model or model == "none":
        return None
    if model == "offline":
        return Offline
    if not base_url:
        raise ValueError(f"llm_model is {model}; set llm_base_url to an endpoint, or llm_model to offline or none")
    return partial(Chat, base_url, model, key)


def summary_prompt(name: str, kind: str, signature: str | None, path: str) -> str:
    return f"{kind} {name}\n{signature or ''}\n{path}"


SYSTEM = {
    "summary": "Answer with a line SUMMARY: one sentence, and a line QUERIES: three questions it answers, split by bars.",
    "flow": "Answer with NARRATION: what happens along this trace, then QUERIES: three questions it answers, split by bars.",
    "guide": "State this repository's conventions for the section as short bullets, or say: no convention.",
}


def complete_all(rows: DataFrame, key: str, prompt: str, purpose: str, provider: Callable | None = None) -> DataFrame:
    """(key, reply): the model's raw reply per row, null where it failed. Each task keeps IN_FLIGHT requests going."""
    make, system, most, flight = provider or Offline, SYSTEM[purpose], REPLY_TOKENS[purpose], IN_FLIGHT[purpose]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()

        def ask(text: str) -> str | None:
            try:
                return client.complete(system, text, most)
            except Exception:  # noqa: BLE001  (a failed request is a null reply)
                return None

        with ThreadPoolExecutor(flight) as pool:
            for f in frames:
                yield pd.DataFrame({key: f[key], "reply": list(pool.map(ask, f[prompt]))})

    return rows.select(key, prompt).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, reply string")
