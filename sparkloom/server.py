"""A small HTTP front: GET /healthz, /readyz, /agents; POST /ask, /ingest. JSON in and out, nothing stored by
clients, errors without details, a bounded number of requests at work, callers told by key or token."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import threading
import time
from collections.abc import Callable, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .errors import AccessDenied, ConfigError
from .operators.filters import Caller

QUESTION_CHARS, HISTORY, HISTORY_CHARS, SLOTS, BODY_BYTES = 4000, 20, 20_000, 16, 1 << 20


class NoAuth:
    """Anyone; for the loopback address alone."""

    loopback_only = True

    def __call__(self, headers: Mapping[str, str]) -> Caller | None:
        return None


class KeyAuth:
    """X-API-Key; keys: what each caller's key admits to."""

    loopback_only = False

    def __init__(self, keys: Mapping[str, Caller]):
        if any(len(k) < 16 for k in keys):
            raise ConfigError("keys need 16 characters at least")
        self.keys = dict(keys)

    def __call__(self, headers: Mapping[str, str]) -> Caller:
        given = headers.get("X-API-Key", "").encode()
        found = None
        for key, caller in self.keys.items():  # all are compared, in constant time each
            if hmac.compare_digest(key.encode(), given):
                found = caller
        if found is None:
            raise AccessDenied("unknown key")
        return found


class TokenAuth:
    """Bearer tokens (JWT, HS256) that have not expired."""

    loopback_only = False

    def __init__(self, secret: bytes, clock: Callable[[], float] = time.time):
        if len(secret) < 32:
            raise ConfigError("the secret needs 32 bytes at least")
        self.secret, self.clock = secret, clock

    def __call__(self, headers: Mapping[str, str]) -> Caller:
        kind, _, token = headers.get("Authorization", "").partition(" ")
        try:
            head, body, signature = token.split(".")
            wide = lambda x: base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))
            ok = kind.lower() == "bearer" and json.loads(wide(head)).get("alg") == "HS256"
            ok = ok and hmac.compare_digest(hmac.new(self.secret, f"{head}.{body}".encode(), hashlib.sha256).digest(), wide(signature))
            claims = json.loads(wide(body)) if ok else {}
            if not ok or not isinstance(claims.get("exp"), int | float) or claims["exp"] <= self.clock():
                raise AccessDenied("no valid token")
        except (ValueError, AttributeError) as e:
            raise AccessDenied("no valid token") from e
        return Caller(tenant_id=claims.get("tenant"), user_id=claims.get("sub"), roles=tuple(claims.get("roles", ())), attributes=claims.get("attributes", {}))


def make_server(agent, port: int = 8080, host: str = "127.0.0.1", auth=None, name: str = "assistant", slots: int = SLOTS) -> ThreadingHTTPServer:
    auth = auth or NoAuth()
    if auth.loopback_only and host not in ("127.0.0.1", "localhost", "::1"):
        raise ConfigError("without authentication only the loopback address is served")
    free = threading.BoundedSemaphore(slots)

    class Handler(BaseHTTPRequestHandler):
        timeout = 60

        def log_message(self, *_):
            pass

        def _send(self, status: int, body: dict) -> None:
            raw = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            for k, v in {"Content-Type": "application/json", "Content-Length": str(len(raw)), "Cache-Control": "no-store"}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):
            if self.path == "/healthz":
                self._send(200, {"status": "ok"})
            elif self.path == "/readyz":
                ready = agent.kb.index.version() > 0
                self._send(200 if ready else 503, {"ready": ready})
            elif self.path == "/agents":
                self._send(200, {"agents": [name]})
            else:
                self._send(404, {"error": "not found"})

        def do_POST(self):
            try:
                caller = auth(self.headers)
            except AccessDenied:
                return self._send(401, {"error": "not admitted"})
            size = int(self.headers.get("Content-Length") or 0)
            if size > BODY_BYTES:
                return self._send(413, {"error": "too large"})
            if not free.acquire(blocking=False):
                return self._send(503, {"error": "busy"})
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
                if self.path == "/ingest":
                    states, _ = agent.kb.ingest()
                    return self._send(200, {r.state: r["count"] for r in states.groupBy("state").count().collect()})
                if self.path != "/ask":
                    return self._send(404, {"error": "not found"})
                question, history = body.get("question"), body.get("history", [])
                if not isinstance(question, str) or not question.strip() or len(question) > QUESTION_CHARS:
                    return self._send(422, {"error": f"a question of 1 to {QUESTION_CHARS} characters is needed"})
                if not isinstance(history, list) or len(history) > HISTORY or sum(len(str(m)) for m in history) > HISTORY_CHARS:
                    return self._send(422, {"error": "the history is too long"})
                return self._send(200, agent.ask(question, caller))
            except ValueError:
                return self._send(400, {"error": "no JSON"})
            except AccessDenied:
                return self._send(403, {"error": "not admitted"})
            except Exception:  # what went wrong is for the log, not for the caller
                return self._send(500, {"error": "the request failed"})
            finally:
                free.release()

    return ThreadingHTTPServer((host, port), Handler)


def serve(agent, port: int = 8080, **options) -> None:
    make_server(agent, port, **options).serve_forever()
