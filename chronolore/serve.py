"""A small HTTP surface over loaded tables: POST /api/ask, POST /api/retrieve and GET /api/health, JSON in and out.

python -m chronolore.serve --graph FOLDER [--port 8080]. Whose eyes an answer is read with comes from the header X-Grants, which a proxy in
front sets; never from the body.
"""

from __future__ import annotations

import argparse
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from chronolore.functions.text import parse_grants
from chronolore.functions.vectors import clamp
from chronolore.plans import ask, load

MOST_BODY = 1 << 20


def asked(body: dict) -> tuple[str, str | None, int]:
    """question, as_of and limit of a request's body."""
    question = str(body.get("question") or "").strip()
    if not question:
        raise ask.ToolError("'question' is required")
    return question, body.get("asOf") or None, clamp(int(body.get("limit") or ask.LIMIT_DEFAULT), 1, ask.LIMIT_MOST)


def answer(t: dict[str, DataFrame], reader: ask.Reader, body: dict) -> dict:
    question, as_of, limit = asked(body)
    got = ask.ask(t, question, reader, as_of, limit=limit).first()
    return {"answer": got["answer"], "refused": got["refused"], "grounded": got["grounded"], "citations": list(got["citations"]), "cards": got["n_cards"]}


def cards(t: dict[str, DataFrame], reader: ask.Reader, body: dict) -> dict:
    question, as_of, limit = asked(body)
    columns = ["rank", "fact_id", "type", "statement", "status", "score", "occurred_at", "valid_to", "owner_name", "title"]
    found = ask.retrieve(t, question, reader, as_of, limit).orderBy("rank").select(*columns)
    return {"facts": [json.loads(r) for r in found.toJSON().collect()]}


def health(t: dict[str, DataFrame], reader: ask.Reader, body: dict) -> dict:
    rows = [r.asDict() for r in load.doctor(t).collect()]
    return {"healthy": all(r["healthy"] for r in rows), "components": rows}


ROUTES = {("POST", "/api/ask"): answer, ("POST", "/api/retrieve"): cards, ("GET", "/api/health"): health}


def server(t: dict[str, DataFrame], host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def handle_route(self, method: str) -> None:
            route = ROUTES.get((method, self.path.split("?")[0]))
            status, said = 404, {"error": "no such path"}
            if route:
                try:
                    size = int(self.headers.get("Content-Length") or 0)
                    if size > MOST_BODY:
                        raise ask.ToolError("the body is too long")
                    body = json.loads(self.rfile.read(size) or b"{}")
                    reader = ask.Reader(self.headers.get("X-Reader") or "anonymous", parse_grants(self.headers.get("X-Grants")))
                    status, said = 200, route(t, reader, body)
                except (ask.ToolError, ValueError, AttributeError) as e:
                    status, said = 400, {"error": str(e)}
            out = json.dumps(said).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def do_GET(self) -> None:  # noqa: N802
            self.handle_route("GET")

        def do_POST(self) -> None:  # noqa: N802
            self.handle_route("POST")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(prog="chronolore.serve")
    args.add_argument("--graph", required=True)
    args.add_argument("--port", type=int, default=8080)
    given = args.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    server(load.read(spark, given.graph), port=given.port).serve_forever()


if __name__ == "__main__":
    main()
