"""Markdown documents: frontmatter, title, sections, code blocks and links."""

from __future__ import annotations

import hashlib
import re

_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})\s*([^\s`]*)")
_LINK = re.compile(r"(!?)\[([^\]]*)\]\(\s*<?([^)\s>]+)>?(?:\s+[\"'][^)]*[\"'])?\s*\)")


def _id(kind: str, *parts) -> str:
    return f"{kind}:{hashlib.sha256(':'.join(map(str, parts)).encode()).hexdigest()[:16]}"


class Document:
    def __init__(self, path: str, text: str):
        lines = text.split("\n")
        self.frontmatter, body = self._front(lines)
        self.sections: list[dict] = []
        self.code_blocks: list[dict] = []
        self.links: list[dict] = []
        fence = None
        for n, line in enumerate(lines[body:], body + 1):
            m = _FENCE.match(line)
            if fence:
                if m and m[1][0] == fence[0][0] and len(m[1]) >= len(fence[0]) and not m[2]:
                    self._block(path, fence, lines, n)
                    fence = None
                continue
            if m:
                fence = (m[1], m[2] or None, n)
                continue
            if h := _HEADING.match(line):
                self.sections.append({"id": _id("section", path, h[2], n), "file_path": path, "heading": h[2], "level": len(h[1]), "start_line": n})
            for x in _LINK.finditer(re.sub(r"`[^`]*`", "", line)):
                if not x[1]:
                    self.links.append({"id": _id("link", path, x[3], n), "file_path": path, "text": x[2], "target": x[3], "line": n})
        if fence:
            self._block(path, fence, lines, len(lines) + 1)
        first = next((s["heading"] for s in self.sections if s["level"] == 1), None)
        title = self.frontmatter.get("title") or self.frontmatter.get("name") or first
        self.document = {"id": _id("md", path), "file_path": path, "title": title, "frontmatter": self.frontmatter, "lines": len(lines)}

    @staticmethod
    def _front(lines: list[str]) -> tuple[dict[str, str], int]:
        if not lines or lines[0].strip() != "---":
            return {}, 0
        end = next((k for k, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)
        if end is None:
            return {}, 0
        out = {}
        for x in lines[1:end]:
            m = re.match(r"([\w-]+):\s*(.*)$", x)
            if m:
                out[m[1]] = m[2].strip().strip("'\"")
        return out, end + 1

    def _block(self, path: str, fence, lines: list[str], end: int) -> None:
        self.code_blocks.append({"id": _id("codeblock", path, fence[2]), "file_path": path, "language": fence[1], "content": "\n".join(lines[fence[2] : end - 1]), "start_line": fence[2], "end_line": min(end, len(lines))})
