"""A client of a chat interface over HTTP, as Toolbox.converse asks it."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable

#: The public interface's address and what holds where nothing is given.
API_BASE, MODEL, TEMPERATURE, MAX_TOKENS = "https://api.openai.com/v1", "gpt-4o", 0.1, 4096


def chat_client(model: str = MODEL, *, api_base: str | None = None, api_key: str | None = None, temperature: float = TEMPERATURE, max_tokens: int = MAX_TOKENS, system: str | None = None, timeout: float = 120) -> Callable:
    """ask(messages, schemas): a text, or a text and the calls (id, name, arguments) that the model makes."""
    key = api_key if api_key is not None else os.environ.get("OPENAI_API_KEY", "")

    def ask(messages: list[dict], schemas: dict[str, dict]):
        tools = [{"type": "function", "function": {"name": n, "description": n.replace("_", " "), "parameters": p}} for n, p in schemas.items()]
        said = [{"role": "system", "content": system}] * bool(system) + [m if m["role"] != "tool" or isinstance(m["content"], str) else m | {"content": json.dumps(m["content"])} for m in messages]
        body = {"model": model, "messages": said, "temperature": temperature, "max_tokens": max_tokens} | ({"tools": tools, "tool_choice": "auto"} if tools else {})
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        request = urllib.request.Request(f"{(api_base or API_BASE).rstrip('/')}/chat/completions", json.dumps(body).encode(), head)
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            message = json.load(reply)["choices"][0]["message"]
        calls = [(c["id"], c["function"]["name"], json.loads(c["function"]["arguments"] or "{}")) for c in message.get("tool_calls") or []]
        return (message.get("content") or "", calls) if calls else message.get("content") or ""

    return ask
