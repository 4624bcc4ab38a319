"""A server for tools over standard input and output: the Model Context Protocol, a JSON-RPC message a line."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import Any, TextIO
from urllib.parse import unquote

from pyspark.sql import SparkSession

from tessera.plans.engine import NAME, pack_to_string, read_resource

#: Versions of the protocol that are spoken, newest first, codes of errors, the resources' scheme.
VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
PARSE, INVALID, UNKNOWN_METHOD, BAD_PARAMETERS = -32700, -32600, -32601, -32602
SCHEME = "bundle://"

#: Arguments of the tool: name in messages, name in Python, type, what it says.
_ARGUMENTS = (
    ("path", "path", "string", "Directory to read."),
    ("template", "template", "string", "Project template; none for every kind of file."),
    ("maxTokens", "max_tokens", "integer", "Token budget; none for no limit."),
    ("includeExtensions", "include_extensions", "string", "Endings to take and no others, separated by commas; they override the template."),
    ("aggressiveMinification", "aggressive_minification", "boolean", "Reduce C# as far as possible."),
)
TOOL = {
    "name": "get_optimized_context",
    "description": "The files of a directory, minified, as one text within a token budget.",
    "inputSchema": {"type": "object", "properties": {name: {"type": kind, "description": about} for name, _, kind, about in _ARGUMENTS}, "required": ["path"]},
    "annotations": {"readOnlyHint": True},
}
RESOURCE = {"uriTemplate": SCHEME + "{template}/{path}", "name": "Bundled directory", "description": "The files of a directory, minified, as one text.", "mimeType": "text/plain"}
_KINDS: dict[str, type] = {"string": str, "integer": int, "boolean": bool}


class Refused(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class Server:
    """Answers messages one after another. tool and resource give texts, those of failures included."""

    def __init__(self, tool: Callable[..., str], resource: Callable[[str, str], str]):
        self.tool, self.resource = tool, resource
        self.methods: dict[str, Callable[[dict], dict]] = {
            "initialize": self._initialize,
            "ping": lambda given: {},
            "tools/list": lambda given: {"tools": [TOOL]},
            "tools/call": self._call,
            "resources/list": lambda given: {"resources": []},
            "resources/templates/list": lambda given: {"resourceTemplates": [RESOURCE]},
            "resources/read": self._read,
        }

    def _initialize(self, given: dict) -> dict:
        asked = given.get("protocolVersion")
        return {"protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": NAME, "version": "1"}}

    def _call(self, given: dict) -> dict:
        if given.get("name") != TOOL["name"]:
            raise Refused(BAD_PARAMETERS, f"Unknown tool: {given.get('name')}")
        arguments = given.get("arguments") or {}
        if not isinstance(arguments.get("path"), str):
            raise Refused(BAD_PARAMETERS, "path is required")
        known: dict[str, Any] = {}
        for name, python, kind, _ in _ARGUMENTS:
            value = arguments.get(name)
            if value is not None:
                if not isinstance(value, _KINDS[kind]) or (kind == "integer" and isinstance(value, bool)):
                    raise Refused(BAD_PARAMETERS, f"{name} must be of type {kind}")
                known[python] = value
        text = self.tool(**known)
        return {"content": [{"type": "text", "text": text}], "isError": text.startswith("Error")}

    def _read(self, given: dict) -> dict:
        uri = str(given.get("uri", ""))
        template, slash, path = uri.removeprefix(SCHEME).partition("/")
        if not uri.startswith(SCHEME) or not slash:
            raise Refused(BAD_PARAMETERS, f"Unknown resource: {uri}")
        return {"contents": [{"uri": uri, "mimeType": "text/plain", "text": self.resource(unquote(template), unquote(path))}]}

    def answer(self, line: str) -> dict | None:
        """The reply to a line; none to a notification."""
        number = None
        try:
            try:
                message = json.loads(line)
            except ValueError:
                raise Refused(PARSE, "Not JSON") from None
            if not isinstance(message, dict) or not isinstance(message.get("method"), str):
                raise Refused(INVALID, "Not a request")
            if "id" not in message:
                return None
            number = message["id"]
            method = self.methods.get(message["method"])
            if method is None:
                raise Refused(UNKNOWN_METHOD, f"Unknown method: {message['method']}")
            return {"jsonrpc": "2.0", "id": number, "result": method(message.get("params") or {})}
        except Refused as refused:
            return {"jsonrpc": "2.0", "id": number, "error": {"code": refused.code, "message": str(refused)}}

    def run(self, source: TextIO, sink: TextIO) -> None:
        """Until the source ends. Only replies go to the sink."""
        for line in source:
            if line.strip():
                reply = self.answer(line)
                if reply is not None:
                    sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
                    sink.flush()


def serve(spark: SparkSession, source: TextIO | None = None, sink: TextIO | None = None) -> None:
    server = Server(lambda **given: pack_to_string(spark, **given), lambda template, path: read_resource(spark, template, path or "."))
    server.run(source or sys.stdin, sink or sys.stdout)
