"""Performance rules over loop and call events: nested loops, I/O in loops, unclosed resources, blocking in async."""

from __future__ import annotations

import re
from typing import Any

#: Rule, severity and title.
RULES = {"PERF001": "warn", "PERF002": "warn", "PERF003": "error", "PERF004": "error"}

#: Method names that query or fetch.
IO_METHODS = frozenset({"query", "execute", "exec", "find", "find_one", "find_many", "find_first", "find_unique", "find_by", "select", "select_all", "fetch", "fetchall", "fetchone", "fetchmany", "raw_query", "queryrow", "query_row", "post", "upsert", "save", "query_context", "exec_context", "query_row_context", "querycontext", "execcontext", "queryrowcontext", "findone", "findmany", "findunique", "findfirst", "findby"})
#: Functions that do I/O by themselves.
IO_FUNCTIONS = frozenset({"fetch", "query", "execute", "select", "urlopen"})
#: receivers' beginnings that mean a request.
IO_PREFIXES = ("requests.", "http.get", "http.post", "http.head", "http.postform", "http.do", "client.get", "client.post", "client.do", "axios.", "reqwest::", "urllib.request.", "aiohttp.", "httpx.", "api.", "session.", "httpclient.", "http_client.", "service.", "c.post", "hc.post")
#: Words of a receiver that make update, insert and delete a database write.
STORE_WORDS = frozenset({"db", "database", "repo", "repository", "table", "tables", "model", "models", "conn", "connection", "cursor", "collection", "collections", "dao", "entity", "entities", "sql"})
#: Words of a receiver that make get a request.
REMOTE_WORDS = frozenset({"http", "client", "request", "requests", "api", "session", "service", "db", "fetch", "conn", "connection", "rest", "remote"})

#: Calls that open something, by language.
OPEN_NAMES = {
    "python": frozenset({"open", "socket.socket", "socket.create_connection", "os.open"}),
    "rust": frozenset({"Box::leak", "std::boxed::Box::leak", "Box::into_raw", "std::boxed::Box::into_raw", "CString::into_raw", "std::ffi::CString::into_raw", "std::mem::forget", "mem::forget", "std::mem::ManuallyDrop::new", "ManuallyDrop::new"}),
}
OPEN_PREFIXES = {
    "typescript": ("fs.open", "fs.createReadStream", "fs.createWriteStream", "net.connect", "net.createConnection", "tls.connect"),
    "go": ("os.Open", "os.OpenFile", "os.Create", "net.Dial", "net.DialTimeout", "net.Listen", "sql.Open", "http.Get", "http.Post", "http.Head"),
}
#: Receivers whose connect opens a connection.
CONNECT_WORDS = ("sqlite", "psycopg", "mysql", "asyncpg", "db", "database", "postgres", "engine", "sql")

#: Blocking calls by language.
BLOCKING = {
    "python": (frozenset({"time.sleep", "sleep", "open", "urllib.request.urlopen", "os.system", "os.popen"}), ("requests.", "subprocess.", "urllib.", "urllib3.", "httpx.")),
    "rust": (frozenset({"std::thread::sleep", "thread::sleep"}), ("std::fs::", "fs::")),
}
#: Names of an async client that do not block.
NOT_BLOCKING = frozenset({"httpx.Timeout", "httpx.Limits"})

_NAME = re.compile(r"[A-Za-z_]\w*", re.ASCII)


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def is_io(callee: str) -> bool:
    parts = re.split(r"\.|::", callee.strip().replace("\n", ""))
    raw = m.group(0) if (m := _NAME.match(parts[-1].strip())) else parts[-1].strip()
    method, low = snake(raw), callee.strip().replace("\n", "").lower()
    if method in IO_METHODS or raw.lower() in IO_METHODS or low in IO_FUNCTIONS or method in IO_FUNCTIONS:
        return True
    if any(low.startswith(p) or f".{p}" in low for p in IO_PREFIXES):
        return True
    words = set(re.split(r"[^a-z0-9]+", snake(parts[-2]))) if len(parts) > 1 else set()
    return method in ("update", "insert", "delete") and bool(words & STORE_WORDS) or method == "get" and bool(words & REMOTE_WORDS)


def opens(callee: str, language: str) -> bool:
    if "(" in callee:
        return False
    if callee in OPEN_NAMES.get(language, ()) or callee.startswith(OPEN_PREFIXES.get(language, ("\0",))):
        return True
    if language == "python" and callee.endswith(".open"):
        return True
    if language == "python" and callee.endswith(".connect"):
        receiver = callee.rsplit(".", 1)[0].lower()
        return any(w in receiver for w in CONNECT_WORDS) or receiver in ("conn", "connection")
    return False


def blocks(callee: str, language: str) -> bool:
    if language == "typescript":
        low = callee.lower()
        return "sync" in low and (low.startswith(("fs.", "child_process.", "crypto.")) or low.endswith("sync")) or callee == "Atomics.wait"
    names, prefixes = BLOCKING.get(language, (frozenset(), ("\0",)))
    return not (callee in NOT_BLOCKING or callee.startswith("httpx.Async")) and (callee in names or callee.startswith(prefixes))


def judge(event: dict[str, Any], language: str, max_depth: int = 2) -> list[dict[str, Any]]:
    """Diagnostics of one event: ``rule_id, severity, lineno, col, message, loop_lines``."""
    at = {"lineno": event["lineno"], "col": event["col"], "loop_lines": event["loop_lines"]}
    out = []
    if event["kind"] == "loop":
        depth = event["depth"]
        if depth >= max(2, max_depth):
            out.append({"rule_id": "PERF001", "severity": "error" if depth >= 3 else "warn", "message": f"Loop nested {depth} deep: O(N^{depth})", **at})
        return out
    callee = event["callee"]
    if event["depth"] and is_io(callee):
        out.append({"rule_id": "PERF002", "severity": "warn", "message": f"I/O call '{callee}' inside a loop", **at})
    if opens(callee, language) and not event["scoped"]:
        out.append({"rule_id": "PERF003", "severity": "error", "message": f"'{callee}' opens a resource that nothing closes", **at})
    if event["in_async"] and not event["awaited"] and blocks(callee, language):
        out.append({"rule_id": "PERF004", "severity": "error", "message": f"Blocking call '{callee}' in an async function", **at})
    return out
