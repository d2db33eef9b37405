"""Display filters: the predicate language of packet lists, compiled to a Column over packet fields.

Names are looked up in a map from field to Column; a bare name asks whether the field is there, `tcp.port` and the like mean
either end. Operators: == != > < >= <= (eq ne gt lt ge le), contains, matches, in {..}, && || ! (and or not), parentheses.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""\s*(?:(?P<op>&&|\|\||==|!=|>=|<=|>|<|!|\(|\)|\{|\}|,)|(?P<str>"(?:\\.|[^"\\])*")|(?P<word>[\w.:/-]+))""")
WORDS = {"eq": "==", "ne": "!=", "gt": ">", "lt": "<", "ge": ">=", "le": "<=", "and": "&&", "or": "||", "not": "!"}
#: Field -> columns of a packet that it stands for.
FIELDS = {
    "frame.number": ["frame_number"], "frame.len": ["length"], "ip.src": ["src_ip"], "ip.dst": ["dst_ip"], "ip.addr": ["src_ip", "dst_ip"], "ip.ttl": ["ttl"],
    "tcp.srcport": ["src_port"], "tcp.dstport": ["dst_port"], "tcp.port": ["src_port", "dst_port"], "udp.port": ["src_port", "dst_port"], "tcp.stream": ["tcp_stream"], "icmp.type": ["icmp_type"],
    "http.request.method": ["http_method"], "http.request.uri": ["http_uri"], "http.response.code": ["http_response_code"], "http.host": ["http_host"], "http.cookie": ["http_cookie"], "http.request": ["http_method"], "http.response": ["http_response_code"],
    "tcp.payload": ["payload"], "data": ["payload"],
}


class Parser:
    def __init__(self, text: str, columns: dict[str, list[Column]], protocol: Column):
        self.toks, at = [], 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if m is None:
                raise ValueError(f"display filter: cannot read {text[at:]!r}")
            kind = m.lastgroup
            value = m.group(kind)
            self.toks.append(("op", WORDS[value]) if kind == "word" and value in WORDS else (kind, value))
            at = m.end()
        self.columns, self.protocol, self.at = columns, protocol, 0

    def peek(self) -> str | None:
        return self.toks[self.at][1] if self.at < len(self.toks) else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.toks) or (want is not None and self.toks[self.at][1] != want):
            raise ValueError(f"display filter: expected {want or 'more'}")
        self.at += 1
        return self.toks[self.at - 1]

    def either(self) -> Column:
        out = self.both()
        while self.peek() == "||":
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while self.peek() == "&&":
            self.take()
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self.peek() == "!":
            self.take()
            return ~self.one()
        if self.peek() == "(":
            self.take()
            out = self.either()
            self.take(")")
            return out
        kind, name = self.take()
        if kind != "word":
            raise ValueError(f"display filter: unexpected {name}")
        columns = self.columns.get(name)
        if columns is None and "." in name:
            raise ValueError(f"display filter: unknown field {name}")
        op = self.peek()
        if op not in ("==", "!=", ">", "<", ">=", "<=", "contains", "matches", "in"):
            return F.coalesce(self.protocol == name.upper(), F.lit(False)) if columns is None else reduce(lambda a, b: a | b, [c.isNotNull() for c in columns])
        self.take()
        if op == "in":
            self.take("{")
            values = [self.value()]
            while self.peek() == ",":
                self.take()
                values.append(self.value())
            self.take("}")
            test = lambda c: reduce(lambda a, b: a | b, [c.cast("string") == v for v in values])
        else:
            v = self.value()
            tests = {
                "==": lambda c: c.cast("string") == v, "!=": lambda c: c.cast("string") != v, ">": lambda c: c > F.lit(v).try_cast("double"), "<": lambda c: c < F.lit(v).try_cast("double"),
                ">=": lambda c: c >= F.lit(v).try_cast("double"), "<=": lambda c: c <= F.lit(v).try_cast("double"), "contains": lambda c: F.contains(c.cast("string"), F.lit(v)), "matches": lambda c: c.cast("string").rlike("(?i)" + v),
            }
            test = tests[op]
        found = [F.coalesce(test(c), F.lit(False)) for c in columns]
        return reduce(lambda a, b: a & b, found) if op == "!=" else reduce(lambda a, b: a | b, found)

    def value(self) -> str:
        kind, v = self.take()
        return re.sub(r"\\(.)", r"\1", v[1:-1]) if kind == "str" else v


def display_filter(text: str, have: list[str], fields: dict[str, list[str]] | None = None) -> Column:
    """The Column of a display filter over packets with the columns `have`."""
    named = {n: [F.col(c) for c in cs] for n, cs in (FIELDS | (fields or {})).items() if all(c in have for c in cs)}
    p = Parser(text, named, F.col("protocol") if "protocol" in have else F.lit(None).cast("string"))
    out = p.either()
    if p.at < len(p.toks):
        raise ValueError(f"display filter: unexpected {p.peek()}")
    return out


def by_protocol(packets: DataFrame, name: str) -> DataFrame:
    """Packets that have a layer: by the array `layers` where there is one, else by the innermost protocol."""
    if "layers" in packets.columns:
        return packets.where(F.array_contains(F.transform("layers", F.lower), name.lower()))
    return packets.where(F.upper("protocol") == name.upper())


def scan(packets: DataFrame, display: str | None = None, columns: list[str] | None = None, limit: int = 0) -> DataFrame:
    """Packets by a display filter, some columns, the first `limit` in capture order (0: all)."""
    out = packets.where(display_filter(display, packets.columns)) if display else packets
    out = out.orderBy("frame_number").limit(limit) if limit else out
    return out.select(*columns) if columns else out
