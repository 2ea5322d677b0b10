"""Language models over HTTP as callables for ``sources.inputs.completed``.

A transport sends one request and gives (status, text); the default uses the standard library. Only what may pass by
itself is tried again: status 429, 5xx and broken connections, after 1, 2, 4, ... seconds.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

#: Seconds of patience, further tries, seconds before the first of them.
PATIENCE = 120
RETRIES = 2
FIRST_WAIT = 1.0

Transport = Callable[[str, dict[str, str], bytes, float], tuple[int, str]]


class ModelRefused(RuntimeError):
    """The service answered with an error that will not pass, or not often enough."""

    def __init__(self, provider: str, status: int, said: str):
        super().__init__(f"{provider} answered {status}: {said[:200]}")
        self.status = status


@dataclass(frozen=True)
class Answer:
    """A completion with what it used; a count that the service did not give is None."""

    text: str
    input_tokens: int | None = None
    output_tokens: int | None = None


def over_network(url: str, headers: dict[str, str], body: bytes, patience: float) -> tuple[int, str]:
    request = urllib.request.Request(url, data=body, headers=headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=patience) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as refused:
        return refused.code, refused.read().decode("utf-8", "replace")


def picked(value, *path):
    """A nested member, or None where any step is missing."""
    for step in path:
        try:
            value = value[step]
        except (KeyError, IndexError, TypeError):
            return None
    return value


@dataclass
class HttpModel:
    """A model of a named provider; subclasses say how a request looks and where the answer stands."""

    key: str
    model: str
    system: str = ""
    max_output_tokens: int = 4096
    temperature: float = 0.0
    transport: Transport = over_network
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)
    provider = "http"

    def request(self, prompt: str) -> tuple[str, dict[str, str], dict]:
        raise NotImplementedError

    def answer(self, body: dict) -> Answer:
        raise NotImplementedError

    def __call__(self, prompt: str) -> Answer:
        url, headers, body = self.request(prompt)
        data = json.dumps(body).encode()
        for attempt in range(RETRIES + 1):
            last = attempt == RETRIES
            try:
                status, said = self.transport(url, {"content-type": "application/json", **headers}, data, PATIENCE)
            except OSError as broken:
                if last:
                    raise ModelRefused(self.provider, 0, str(broken)) from broken
            else:
                if 200 <= status < 300:
                    try:
                        return self.answer(json.loads(said))
                    except ValueError:
                        raise ModelRefused(self.provider, status, f"no JSON: {said}") from None
                if last or not (status == 429 or status >= 500):
                    raise ModelRefused(self.provider, status, said)
            self.sleep(FIRST_WAIT * 2**attempt)
        raise AssertionError


class OpenAi(HttpModel):
    provider = "openai"

    def request(self, prompt: str) -> tuple[str, dict[str, str], dict]:
        messages = [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]
        body = {"model": self.model, "messages": messages, "max_completion_tokens": self.max_output_tokens, "temperature": self.temperature}
        return "https://api.openai.com/v1/chat/completions", {"authorization": f"Bearer {self.key}"}, body

    def answer(self, body: dict) -> Answer:
        return Answer(picked(body, "choices", 0, "message", "content") or "", picked(body, "usage", "prompt_tokens"), picked(body, "usage", "completion_tokens"))


class Gemini(HttpModel):
    provider = "gemini"

    def request(self, prompt: str) -> tuple[str, dict[str, str], dict]:
        body = {
            "systemInstruction": {"parts": [{"text": self.system}]},
            "contents": [{"role": "user", "parts": [{"text": prompt}]}],
            "generationConfig": {"maxOutputTokens": self.max_output_tokens, "temperature": self.temperature},
        }
        return f"https://generativelanguage.googleapis.com/v1beta/models/{self.model}:generateContent", {"x-goog-api-key": self.key}, body

    def answer(self, body: dict) -> Answer:
        parts = picked(body, "candidates", 0, "content", "parts") or []
        return Answer("".join(p.get("text", "") for p in parts), picked(body, "usageMetadata", "promptTokenCount"), picked(body, "usageMetadata", "candidatesTokenCount"))
