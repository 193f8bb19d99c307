"""A client for vision models behind an OpenAI-compatible endpoint, for ``operators.batch``."""

from __future__ import annotations

import base64
import json
import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import SparkSession

from folioscope.functions.ids import IMAGE_TYPES


def load_prompt(spark: SparkSession, path: str) -> str:
    """A prompt file's text, from wherever Spark reads."""
    return spark.read.text(path, wholetext=True).first()["value"]


def image_message(prompt: str, name: str, content: bytes) -> list[dict]:
    """The messages of one request: a text and an image as a data URL."""
    kind = IMAGE_TYPES.get(name.rpartition(".")[2].lower())
    if kind is None:
        raise ValueError(f"unsupported image type: {name}")
    url = f"data:{kind};base64,{base64.b64encode(content).decode()}"
    return [{"role": "user", "content": [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": url}}]}]


def chat_client(base_url: str, temperature: float = 0.0, max_tokens: int = 4096, timeout: float = 600.0, send: Callable[[str, bytes], bytes] | None = None) -> Callable[[dict], dict]:
    """A function from a job (model, prompt, image_name, image_content) to its reply. One request, no
    retries: what fails stays pending. ``send``: posts a body to an address, for tests."""

    def post(url: str, body: bytes) -> bytes:
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.read()

    def ask(job: dict) -> dict:
        body = {"model": job["model"], "messages": image_message(job["prompt"], job["image_name"], job["image_content"]), "temperature": temperature, "max_tokens": max_tokens}
        began = time.monotonic()
        answer = json.loads((send or post)(f"{base_url.rstrip('/')}/chat/completions", json.dumps(body).encode()))
        choice = answer["choices"][0]
        return {"content": choice["message"]["content"] or "", "finish_reason": choice.get("finish_reason"), "elapsed_seconds": time.monotonic() - began}

    return ask
