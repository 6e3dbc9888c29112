"""A small HTTP front for development: POST /<prefix>/<stream> with {"data": [...]} lines lands them in the stream's folder.

Each request becomes one file, written under another name and renamed, so a stream that watches the folder sees
whole requests only. For production loads, land files or use a message broker.
"""

from __future__ import annotations

import json
import os
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path


class IngestServer:
    """with IngestServer({"name": folder}) as s: POST to http://127.0.0.1:{s.port}/v1/streams/name"""

    def __init__(self, folders: dict[str, str], port: int = 0, prefix: str = "v1/streams", limit: int = 8_000_000) -> None:
        self.folders = {n: Path(f) for n, f in folders.items()}
        for f in self.folders.values():
            f.mkdir(parents=True, exist_ok=True)
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self) -> None:  # noqa: N802
                head, _, name = self.path.strip("/").rpartition("/")
                size = int(self.headers.get("Content-Length") or 0)
                if head != prefix or name not in outer.folders:
                    return self.send_error(404, "no such stream")
                if size > limit:
                    return self.send_error(413, "too large")
                try:
                    lines = [json.loads(x) for x in self.rfile.read(size).decode().splitlines() if x.strip()]
                    if not lines or any(not isinstance(x.get("data"), list) for x in lines):
                        raise ValueError
                except (ValueError, AttributeError, UnicodeDecodeError):
                    return self.send_error(400, '{"data": [...]} lines are due')
                outer.land(name, lines)
                self.send_response(200)
                self.send_header("Content-Length", "0")
                self.end_headers()
                return None

            def log_message(self, *_args) -> None:
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
        self.port = self.server.server_address[1]

    def land(self, name: str, lines: list[dict]) -> None:
        folder = self.folders[name]
        part = folder / f".{uuid.uuid4().hex}"
        part.write_text("".join(json.dumps(x) + "\n" for x in lines))
        os.replace(part, folder / f"{uuid.uuid4().hex}.json")

    def __enter__(self) -> IngestServer:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_error) -> None:
        self.server.shutdown()
        self.server.server_close()
