"""Translation services: what they are asked, their answers, and what ends a run early. The HTTP call is injected."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from recordloom.operators.chunks import packed, rejoined

#: Texts of one request.
BATCH = 25
#: (url, params, headers, body) to (status, body).
Http = Callable[[str, dict, dict, object], tuple[int, bytes]]


class TranslationError(Exception):
    """A service's refusal; `done` has the translations that were made before, in order."""

    def __init__(self, message: str, done: list[str] | None = None):
        super().__init__(message)
        self.done = done or []


def _ok(service: str, status: int, body: bytes, reasons: dict[int, str]) -> object:
    if status >= 400:
        raise TranslationError(f"{service}: {reasons.get(status, f'HTTP {status}')}")
    try:
        return json.loads(body)
    except ValueError:
        raise TranslationError(f"{service}: the answer can't be read") from None


def azure(texts: list[str], target: str, http: Http, key: str, region: str = "", source: str = "") -> list[str]:
    params = {"api-version": "3.0", "to": target} | ({"from": source} if source else {})
    headers = {"Ocp-Apim-Subscription-Key": key} | ({"Ocp-Apim-Subscription-Region": region} if region else {})
    answer = _ok("Azure", *http("https://api.cognitive.microsofttranslator.com/translate", params, headers, [{"text": t} for t in texts]), {401: "the key isn't accepted", 403: "the quota is used up", 429: "too many requests"})
    return [item["translations"][0]["text"] for item in answer]


def deepl(texts: list[str], target: str, http: Http, key: str, region: str = "", source: str = "") -> list[str]:
    host = "api-free.deepl.com" if key.endswith(":fx") else "api.deepl.com"
    body = {"text": texts, "target_lang": {"en": "EN-GB", "pt": "PT-PT"}.get(target.lower(), target.upper())} | ({"source_lang": source.upper()} if source else {})
    answer = _ok("DeepL", *http(f"https://{host}/v2/translate", {}, {"Authorization": f"DeepL-Auth-Key {key}"}, body), {403: "the key isn't accepted", 429: "too many requests", 456: "the quota is used up"})
    return [item["text"] for item in answer["translations"]]


def quota_message(text: str, mail: str = "") -> str | None:
    """What an answer says of a used-up daily quota, with the wait it names; None if it says nothing of one."""
    if not re.search(r"quota|limit|all available free translations", text, re.I):
        return None
    wait = re.search(r"(\d+)\s*hours?(?:\s*(\d+)\s*minutes?)?", text, re.I)
    left = f"; it is renewed in {wait[1]} h {wait[2] or 0} min" if wait else ""
    return f"MyMemory: today's quota is used up{left}" + ("" if mail else "; an e-mail address raises it")


def mymemory(texts: list[str], target: str, http: Http, mail: str = "", region: str = "", source: str = "en") -> list[str]:
    """One chunk a request; a text's translations are joined again."""
    out: list[str] = []
    for text in texts:
        parts, chunks = [], packed(text)
        for chunk, _ in chunks:
            answer = _ok("MyMemory", *http("https://api.mymemory.translated.net/get", {"q": chunk, "langpair": f"{source or 'en'}|{target}"} | ({"de": mail} if mail else {}), {}, None), {429: "too many requests"})
            found = str((answer.get("responseData") or {}).get("translatedText") or "")
            if str(answer.get("responseStatus")) != "200":
                raise TranslationError(quota_message(found or str(answer.get("responseDetails")), mail) or f"MyMemory: {answer.get('responseDetails')}", out)
            parts.append(found)
        out.append(rejoined(parts, (glued for _, glued in chunks)))
    return out


PROVIDERS: dict[str, Callable[..., list[str]]] = {"azure": azure, "deepl": deepl, "mymemory": mymemory}


def non_blank(texts: list[str | None]) -> list[int]:
    return [i for i, t in enumerate(texts) if (t or "").strip()]


def translate(texts: list[str | None], target: str, provider: str, http: Http, key: str = "", region: str = "", source: str = "", batch: int = BATCH) -> list[str]:
    """Translations in the texts' order; blanks pass through unasked. A refusal keeps what was translated before it."""
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider: {provider}")
    out = [t or "" for t in texts]
    places = non_blank(texts)
    for at in range(0, len(places), batch):
        some = places[at : at + batch]
        try:
            found = PROVIDERS[provider]([out[i] for i in some], target, http, key, region, source)
        except TranslationError as refused:
            done = [out[i] for i in places[:at]] + refused.done
            raise TranslationError(str(refused), done) from None
        for i, text in zip(some, found, strict=True):
            out[i] = text
    return out


@dataclass
class Stats:
    """What became of a column's cells."""

    rows: int
    counts: dict[str, int] = field(default_factory=dict)

    def add(self, status: str, n: int = 1) -> None:
        self.counts[status] = self.counts.get(status, 0) + n

    def lines(self, column: str) -> Iterator[str]:
        yield f"{column}: {self.rows} rows"
        yield from (f"  {status}: {n}" for status, n in sorted(self.counts.items()))
