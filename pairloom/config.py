"""Settings: defaults, a YAML file over them, environment variables over both; secrets come from the environment alone."""

from __future__ import annotations

import os
from copy import deepcopy

from pairloom.functions.hybrid import WEIGHTS
from pairloom.operators.chunking import DIM, OVERLAP, SIZE
from pairloom.operators.matching import SECTION_WEIGHTS

DEFAULTS = {
    "retrieval": {"pool_size": 50, "top_k": 10, "keyword_alpha": 0.5},
    "matching": {"pairing": "cross", "aggregation": "weighted", "section_weights": dict(SECTION_WEIGHTS), "chunk_size": SIZE, "chunk_overlap": OVERLAP, "dim": DIM},
    "ranking": {"weights": dict(WEIGHTS)},
}
PREFIX = "PAIRLOOM_"


def _merged(base: dict, over: dict) -> dict:
    out = deepcopy(base)
    for k, v in over.items():
        out[k] = _merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def parse_yaml(text: str) -> dict:
    """The part of YAML that settings need: nested maps by indentation, scalars, comments."""
    root: dict = {}
    open_: list[tuple[int, dict]] = [(-1, root)]
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth, (key, colon, value) = len(line) - len(line.lstrip()), line.strip().partition(":")
        if not colon or key.startswith("- "):
            raise ValueError(f"line {n}: only maps and scalars are settings")
        while open_[-1][0] >= depth:
            open_.pop()
        if value.strip():
            open_[-1][1][key.strip()] = scalar(value.strip())
        else:
            open_[-1][1][key.strip()] = below = {}
            open_.append((depth, below))
    return root


def scalar(text: str):
    if text[:1] in "'\"" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.lower() in ("true", "false", "null", "~"):
        return {"true": True, "false": False}.get(text.lower())
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def load(path: str | None = None, env: dict[str, str] | None = None) -> dict:
    """The settings. PAIRLOOM_RETRIEVAL__TOP_K=5 sets retrieval.top_k."""
    found, env = deepcopy(DEFAULTS), os.environ if env is None else env
    if path:
        with open(path, encoding="utf-8") as f:
            found = _merged(found, parse_yaml(f.read()))
    for name, value in env.items():
        if name.startswith(PREFIX) and "__" in name:
            *head, last = name[len(PREFIX) :].lower().split("__")
            over: dict = {last: scalar(value)}
            for h in reversed(head):
                over = {h: over}
            found = _merged(found, over)
    return found


def database_options(env: dict[str, str] | None = None) -> dict[str, str]:
    """JDBC options out of DATABASE_URL (postgresql://user:password@host:port/name); without it there is no database."""
    from urllib.parse import unquote, urlsplit

    url = (os.environ if env is None else env).get("DATABASE_URL")
    if not url:
        raise KeyError("DATABASE_URL is not set")
    u = urlsplit(url)
    place = f"jdbc:postgresql://{u.hostname}{f':{u.port}' if u.port else ''}{u.path}"
    return {"url": place, "user": unquote(u.username or ""), "password": unquote(u.password or ""), "driver": "org.postgresql.Driver"}
