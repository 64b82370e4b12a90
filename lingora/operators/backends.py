"""Backends that translate lists of texts, and which one a project's settings ask for. All run in Python workers."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

Backend = Callable[[list[str]], list[str]]

#: How models are asked to generate.
GENERATION = {"max_new_tokens": 512, "no_repeat_ngram_size": 3, "num_beams": 1}


def generation(src_lang: str | None, tgt_lang: str | None) -> dict:
    """Settings of a model's call; tagged models are told both languages."""
    return GENERATION | ({"src_lang": src_lang, "tgt_lang": tgt_lang} if src_lang and tgt_lang else {})


def echo(locale: str) -> Backend:
    """A deterministic backend: each text behind its target's name."""
    return lambda texts: [f"[{locale}] {t}" for t in texts]


def dictionary(words: dict[str, str]) -> Backend:
    """A backend that knows some texts and repeats the others."""
    return lambda texts: [words.get(t, t) for t in texts]


def answers(payload, texts: list[str]) -> list[dict]:
    """A service's answer, an array or one under `translations`, as (source, translation, translation_source, confidence)."""
    items = payload.get("translations") if isinstance(payload, dict) else payload
    if not isinstance(items, list):
        raise ValueError("a service must answer with an array, or with one under translations")
    out = []
    for i, text in enumerate(texts):
        item = items[i] if i < len(items) else None
        if isinstance(item, str):
            item = {"translation": item}
        if not isinstance(item, dict) or not isinstance(item.get("translation"), str):
            raise ValueError(f"answer {i} is not a translation")
        number = item.get("confidence")
        out.append({
            "source": item["source"] if isinstance(item.get("source"), str) else text, "translation": item["translation"],
            "translation_source": "glossary" if item.get("translationSource") == "glossary" else "machine",
            "confidence": float(number) if isinstance(number, int | float) and not isinstance(number, bool) else None,
        })
    return out


def _post(url: str, body: bytes, headers: dict[str, str], seconds: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=seconds) as answer:
        return answer.read()


#: Characters of a refusal's body that an error repeats.
SHOWN = 200


def refusal(error: urllib.error.HTTPError) -> str:
    """Status and reason of a service's refusal, and the beginning of what it says, on one line."""
    try:
        said = " ".join(error.read().decode("utf-8", "replace").split())
    except Exception:
        said = ""
    told = f"{error.code} {error.reason} ({error.url})"
    return f"{told}: {said[:SHOWN]}{'...' if len(said) > SHOWN else ''}" if said else told


def service(endpoint: str | None, source: str, target: str, glossary: dict[str, str] | None = None, key: str | None = None, timeout: int = 30000, post=_post) -> Callable[[list[str]], list[dict]]:
    """A service that is sent texts and locales as JSON; without an endpoint, texts stay as they are, with confidence 0."""

    def ask(texts: list[str]) -> list[dict]:
        if not endpoint:
            return [{"source": t, "translation": t, "translation_source": "machine", "confidence": 0.0} for t in texts]
        headers = {"content-type": "application/json"} | ({"authorization": f"Bearer {key}"} if key else {})
        body = json.dumps({"texts": texts, "sourceLocale": source, "targetLocale": target, "glossary": glossary or {}}).encode()
        try:
            raw = post(endpoint, body, headers, timeout / 1000)
        except urllib.error.HTTPError as error:
            raise RuntimeError(f"the service refused {len(texts)} text(s): {refusal(error)}") from error
        except Exception as error:
            raise RuntimeError(f"no answer from {endpoint} to {len(texts)} text(s) within {timeout} ms") from error
        try:
            return answers(json.loads(raw), texts)
        except ValueError as error:
            raise RuntimeError(f"no valid answer from {endpoint}") from error

    return ask


def chosen(settings: dict, local: Backend, registered: dict[str, Callable[[dict], Backend]] | None = None) -> Backend:
    """The backend that settings name: a registered one, the service if it has an endpoint, else the local one."""
    options = settings["translator"]
    name = options.get("name", "local")
    if name in (registered or {}):
        return registered[name](settings)
    if name == "api" and options.get("endpoint"):
        ask = service(options["endpoint"], settings["source_locale"], settings["target_locale"], key=options.get("api_key"), timeout=options["timeout"])
        return lambda texts: [x["translation"] for x in ask(texts)]
    return local


# What is told of a failed request, in this order.
_DETAILS = ("code", "errno", "syscall", "hostname", "address", "port", "url")


def error_chain(error: BaseException | str) -> str:
    """An error and its causes, a line each, with what is known of the request."""
    lines, seen, here = [], set(), error
    while here is not None and id(here) not in seen:
        seen.add(id(here))
        if isinstance(here, BaseException):
            name = "" if type(here) is Exception else f"{type(here).__name__}: "
            details = ", ".join(f"{d}={getattr(here, d)}" for d in _DETAILS if getattr(here, d, None) not in (None, ""))
            said = f"{name}{str(here) or 'Unknown error'}" + (f" ({details})" if details else "")
        else:
            said = str(here)
        lines.append(said if not lines else f"Caused by: {said}")
        here = getattr(here, "__cause__", None)
    return "\n".join(lines)
