"""Credentials in source code, found and masked by a conditional random field (problem 7).

Lines that hold a literal with both letters and digits, a name or word that tells
of a credential before a literal, an authorization scheme or a private key's BEGIN
mark are cut into lexical tokens; a linear-chain
conditional random field with shape and context features labels each token as
outside, begin of a credential, between its pieces, or a further piece, and the
Viterbi spans are what is masked.  The field is trained on lines that a seeded
grammar writes (``training_lines``), so that nothing depends on the data; the
bound is TRAINING_LINES.

A private key over several lines is masked from behind its BEGIN mark to its END
mark.  Masking replaces each character of a credential by ``MASK``; everything
else, line ends included, stays as it is.  Defined results: null and empty texts
hold nothing; rows delivered twice count once; very long texts are read whole;
empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import base64
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cstloom.llm.crf import Crf, hashed
from cstloom.operators import nested

TRAINING_LINES = 12_000
MASK = "x"
OUT, BEGIN, BETWEEN, PIECE = range(4)

_TOKEN = re.compile(r"-----BEGIN [A-Z ]+-----|-----END [A-Z ]+-----|\$\{[^}\s]*\}|\\[nrt\"']|(?:[A-Za-z0-9_]|(?<=[\"'\s=])[+/](?!/)(?=[\w+/]{20}))[\w+/\-.$#*?!~%^&]*(?:={1,2}(?=[\"'`\s,;)&<]|$))?|\S")
_DIGIT_LINE = re.compile(r"(?m)^[^\n\d]*\d[^\n]*")
_RUN = re.compile(r"[\w+/=.$#*?!~%^&-]{6,}")
_SCHEME = re.compile(r"(?:Bearer|Basic) +[\w+/]|BEGIN [A-Z ]*PRIVATE KEY|//[^\s/:@\"']+:[^\s/:@\"'{}]+@")
_NAMED = re.compile(r"""(?:[Pp](?:ass|ASS|wd|WD)|PASS|PWD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Cc]red|CRED|[Kk]ey|KEY|[Kk]ennwort|[Cc]ontrase|[Ll]ogin|LOGIN|[Ss]ign_?[Ii]n|[Aa]uth|AUTH|(?<![A-Za-z])(?:pw|PW|pin|PIN)(?![a-z]))[^\n]*["'`=:/]""")
#: Words of a comment that announce a credential.
_TOLD = {"login", "user", "credentials", "account", "pw", "password", "pass", "passwd", "pwd", "token", "secret", "key", "passphrase"}
#: Parts of names that stand for credentials, names with key that do, and parts that speak against one.
SECRET_PARTS = {"password", "passwd", "pwd", "pass", "passphrase", "passcode", "pw", "secret", "token", "credential", "credentials", "cred", "creds", "apikey", "passwort", "kennwort", "contrasena"}
KEY_PARTS = {"api", "secret", "private", "deploy", "hmac", "signing", "sign", "access", "auth", "encryption", "encrypt", "master", "session", "ssh", "license", "service", "client", "root", "admin"}
BENIGN_PARTS = {"checksum", "sha", "sha1", "sha256", "md5", "hash", "digest", "integrity", "id", "uuid", "guid", "icon", "image", "public", "pub", "commit", "revision", "etag", "version", "fingerprint", "color", "data", "query", "url", "uri", "codes", "field", "marker"}
PLACEHOLDERS = {"changeme", "change", "todo", "dummy", "example", "sample", "test", "null", "none", "nil", "undefined", "true", "false", "secret", "password", "token", "your", "xxx", "redacted", "placeholder", "fixme", "from", "env", "not", "real", "set", "me", "default", "insert", "here", "fake", "foo", "bar"}


def name_parts(name: str) -> list[str]:
    return [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)]


@lru_cache(1 << 16)
def name_class(name: str | None) -> str:
    if not name:
        return "none"
    parts = name_parts(name)
    have = set(parts)
    joined = "".join(parts)
    if have & BENIGN_PARTS and not ({"id"} == have & BENIGN_PARTS and have & SECRET_PARTS and len(parts) > 3):
        return "benign"
    if "key" in have and have & KEY_PARTS or joined in ("apikey", "secretkey", "passphrase"):
        return "secret"
    if have & SECRET_PARTS:
        # a token_array or a password_width is about something else; a secret's name ends with the secret
        return "secret" if parts[-1] in SECRET_PARTS | {"phrase", "key", "value"} else "about"
    if {"phrase"} & have and "pass" in joined:
        return "secret"
    return "key" if "key" in have else "other"


@lru_cache(1 << 16)
def holds_place(token: str) -> bool:
    return bool(set(name_parts(token)) & PLACEHOLDERS) and not any(c.isdigit() for c in token)


@lru_cache(1 << 16)
def _code(name: str) -> int:
    return hashed([name])[0]


def _bucket(n: int) -> str:
    return next((str(b) for b in (3, 5, 8, 12, 16, 20, 26, 31, 33, 39, 41, 45, 63, 65, 100, 200) if n <= b), "long")


_SHAPES = [
    ("begin_private", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")), ("begin_other", re.compile(r"-----BEGIN ")), ("end", re.compile(r"-----END ")), ("reference", re.compile(r"\$\{")), ("escape", re.compile(r"\\.$")),
    ("jwt", re.compile(r"eyJ[\w-]{8,}\.[\w-]{8,}\.?")), ("uuid", re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")), ("sri", re.compile(r"sha\d{3}-[\w+/=]{20,}")),
    ("digits", re.compile(r"\d{6,12}$")), ("words", re.compile(r"(?:[A-Z][a-z]{2,}[-_.+]?){3,}$")), ("number", re.compile(r"[\d.,_]+%?$|0x[0-9a-fA-F]+$")), ("hex", re.compile(r"(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{8,}$")), ("word", re.compile(r"[a-z]+$")), ("Word", re.compile(r"[A-Z][a-z]+$")), ("CAPS", re.compile(r"[A-Z]+(?:_[A-Z]+)*$")),
    ("name", re.compile(r"[a-z]+(?:[_.][a-z_.]+)+$|[a-z]+(?:[A-Z][a-z]+)+$|(?:[A-Z][a-z]+){2,}$")), ("path", re.compile(r"[a-z]+(?:[/.:-][a-z]+)+(?:-\d{1,4})?(?:\.\w{1,4})?$|[a-z]+-\d{1,4}$|[a-z]+\d{0,2}$")),
    ("stars", re.compile(r"[*x.#]{3,}$")), ("capsdigits", re.compile(r"(?=[A-Z]*\d)[A-Z][A-Z0-9]{13,}$")), ("prefixed", re.compile(r"[a-z]{2,6}(?:[_.-][a-z]{1,5})?[_.-](?=[\w-]*\d)(?=[\w-]*[A-Z])[\w-]{10,}$")),
    ("dotted", re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$")), ("base64", re.compile(r"(?=\S*[A-Z])(?=\S*[a-z])[A-Za-z0-9+/]{12,}={1,2}$")), ("phrase", re.compile(r"[A-Za-z]*[A-Z]?[a-z]{3,}(?:[-_.#+!][A-Za-z]+)*[-_.#+!]?\d{1,5}[?!*+#$%]?$")), ("mingled", re.compile(r"[a-z]{2,5}\d{1,3}[A-Z][a-z]+\$?\w{0,6}$")),
    ("mixed", re.compile(r"(?=\S*[A-Z])(?=\S*[a-z])(?=\S*\d)[A-Za-z0-9]{16,}$")), ("mixeddot", re.compile(r"(?=\S*[A-Z])(?=\S*[a-z])(?=\S*\d)[A-Za-z0-9]{6,}\.[A-Za-z0-9]{8,}$")), ("mixedsym", re.compile(r"(?=\S*[A-Z])(?=\S*[a-z])(?=\S*\d)\S{16,}$")), ("alnum", re.compile(r"(?=\S*[A-Za-z])(?=\S*\d)\S{6,}$")),
]


@lru_cache(1 << 16)
def shape(token: str) -> str:
    if len(token) == 1:
        return token if not token.isalnum() else "1"
    if len(token) > 400:  # only a signed token may be so long; all else is data, whatever its letters
        return "jwt" if dict(_SHAPES)["jwt"].match(token) else "mixed" if not token.isalpha() else "word"
    for name, rule in _SHAPES:
        if rule.match(token):
            return name
    return "text" if token[0].isalnum() else "odd"


def featured(line: str) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """The tokens of a line (begin, end) and their hashed features."""
    spans = [m.span() for m in _TOKEN.finditer(line)]
    toks = [line[a:b] for a, b in spans]
    shapes = [shape(t) for t in toks]
    n = len(toks)
    key, call, args, after, url = None, "none", 0, "none", 0
    comment = line.lstrip().startswith(("//", "#", "*", "/*", "--", ";"))
    quote = None
    out = []
    for i, (t, s) in enumerate(zip(toks, shapes)):
        if t in ("=", ":") and i and (quote is None or comment):
            j = i - 1
            while j >= 0 and toks[j] in ('"', "'", ":"):
                j -= 1
            if j >= 0 and re.match(r"[A-Za-z_][\w.\-]*$", toks[j]) and toks[i + 1 : i + 2] != ["/"]:
                key = toks[j]
        elif t == "(" and i and quote is None:
            call, args = ("login" if re.fullmatch(r"(?i)(?:[\w.]*_?)?(?:login|basic_?auth|authenticate|sign_?in|set_?credentials|connect)", toks[i - 1]) else "call"), 0
        elif t == "," and quote is None:
            args += 1
        if t in ("Bearer", "Basic", "Token", "bearer", "basic"):
            after = t.lower()
        if t == "/" and toks[i - 1 : i] == ["/"] and toks[i - 2 : i - 1] == [":"]:
            url = 1
        elif url == 1 and t == ":":
            url = 2
        elif url and t in ("@", '"', "'"):
            url = 0
        at = any(x == "@" for x in toks[i + 1 : i + 2]) and url == 2
        p1, p2 = toks[i - 1] if i else "^", toks[i - 2] if i > 1 else "^"
        n1, n2 = toks[i + 1] if i + 1 < n else "$", toks[i + 2] if i + 2 < n else "$"
        joined = p1 in "\"'`" and toks[i - 2 : i - 1] in (["+"], [".."], ["."]) or False
        joins = n1 in "\"'`" and n2 in ("+", "..", ".") and i + 3 < n and toks[i + 3] in "\"'`"
        c = name_class(key)
        login = comment and any(x.lower().strip(".,") in _TOLD for x in toks[max(0, i - 4) : i])
        placeholder = holds_place(t)
        role = f"{s}|{_bucket(len(t)) if s not in ('word', 'name', 'number') else ''}"
        names = [
            "bias", f"s={s}", f"r={role}", f"s,c={s},{c}", f"r,c={role},{c}", f"s,p={s},{shapes[i - 1] if i else '^'}", f"s,n={s},{shapes[i + 1] if i + 1 < n else '$'}", f"s,after={s},{after}",
            f"s,call={s},{call},{min(args, 2)}", f"s,url={s},{url},{at}", f"s,join={s},{joined},{joins}", f"c,join={c},{joined},{joins},{s}", f"s,login={s},{login},{p1 == '/'}", f"hold={placeholder},{c}", f"q={quote is not None},{s}", f"p={p1 if len(p1) == 1 else 'w'},{p2 if len(p2) == 1 else 'w'},{n1 if len(n1) == 1 else 'w'}",
        ]
        out.append([_code(x) for x in names])
        if t in ('"', "'", "`"):
            quote = None if quote == t else quote or t
        if t in ('"', "'") and quote is None:
            after = "none"
        if t in (",", ";", "{", "}") and quote is None:
            key = None if t != "," or call == "none" else key
    return spans, out


# --- the grammar of training lines ---

_SYLLABLES = [c + v for c in ("b", "br", "d", "f", "fl", "g", "gr", "h", "j", "k", "kl", "l", "m", "n", "p", "pl", "r", "s", "sk", "st", "t", "tr", "v", "w", "z") for v in ("a", "e", "ai", "ea", "io", "ou", "u", "ol", "in", "and")]
_ENGLISH = "record buffer index table route stream model layer report page session market window channel budget signal token vector object header cache worker order price entry field letter season travel paper garden".split()
_SECRET_NAMES = "password passwd pwd smtp_password db_password admin_pass root_pw pass_phrase login_secret client_secret secret_key webhook_secret api_key apikey access_token auth_token refresh_token token deploy_key hmac_key private_key signing_key credential encryption_key access_key".split()
_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_ALNUM = _B64[:62]


class _Writer:
    """Writes one labelled line after another; a credential's pieces are given between \\1 and \\2."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, xs):
        return xs[self.r.randrange(len(xs))]

    def word(self) -> str:
        return self.pick(_ENGLISH) if self.r.random() < 0.4 else "".join(self.pick(_SYLLABLES) for _ in range(self.r.randint(2, 3)))

    def chars(self, alphabet: str, n: int) -> str:
        return "".join(self.pick(alphabet) for _ in range(n))

    def style(self, name: str) -> str:
        parts, how = name.split("_"), self.r.randrange(5)
        return [name, parts[0] + "".join(p.title() for p in parts[1:]), name.upper(), name.replace("_", "."), name][how]

    def ident(self) -> str:
        return self.style("_".join(self.word() for _ in range(self.r.randint(1, 3))))

    def phrase(self) -> str:
        """A password made of words, as people choose them."""
        w, r = self.word().title(), self.r
        return self.pick([
            f"{w}{self.pick(['-', '_', '.', '#', '!', ''])}{self.word()}{r.randint(1, 9999)}", f"{w}{r.randint(100, 9999)}{self.pick('?!*+#$%')}", f"{w}-{self.word()}-{self.word()}-{r.randint(1, 99)}", f"{w}_{self.word()}{r.randint(10, 9999)}", f"{w}.{self.word()}{r.randint(10, 9999)}",
            f"{w[:3].lower()}{r.randint(10, 99)}{self.word().title()}${self.chars(_ALNUM, 3)}", f"{w}{self.word()}{r.randint(10, 9999)}", f"{w}{self.chars('0123456789', 4)}{self.pick('?!*+')}", f"{self.word()}{self.pick('#!$')}{r.randint(10, 9999)}",
        ])

    def opaque(self) -> str:
        r, c = self.r, self.chars
        return self.pick([
            c(_ALNUM, 32), c(_ALNUM, r.randint(24, 48)), c(_B64, 43) + "=", c(_B64, 42) + "==", c("0123456789abcdef", 40), c("0123456789abcdef", 64), c("0123456789abcdef", 32), c(_ALNUM, 10) + "." + c(_ALNUM, 34), self.known(), self.known(),
        ])

    def known(self) -> str:
        """A key whose own form tells what it is."""
        r, c, w = self.r, self.chars, self.word()
        lead = c("abcdefghijklmnopqrstuvwxyz", r.randint(2, 4))
        return self.pick([
            f"{lead}.{self.pick('sbk')}.{c(_ALNUM, 26)}", f"{lead}-{c(_ALNUM, 8)}-{c(_ALNUM, 20)}", f"{lead}_live_{c(_ALNUM, 28)}", f"{lead}_{c(_ALNUM, 36)}", c("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3) + "K" + c("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), f"{lead}-{w[:4]}-{c(_ALNUM, 24)}",
        ])

    def jwt(self) -> str:
        e = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
        return e('{"alg": "HS256", "typ": "JWT"}') + "." + e(f'{{"sub": "{self.word()}", "iat": {self.r.randint(10**9, 2 * 10**9)}}}') + "." + self.chars(_ALNUM + "-_", 43)

    def assign(self, name: str, value: str, quoted: bool | None = None) -> str:
        r = self.r
        if quoted is None:
            quoted = r.random() < 0.85
        v = f'"{value}"' if quoted else value
        lead = " " * r.choice((0, 2, 4, 8))
        kinds = [f"{lead}{name} = {v}", f"{lead}const {name} = {v};", f"{lead}let {name} = {v};", f"{lead}var {name} = {v};", f"{lead}auto {name} = {v};", f"{lead}{name} := {v}", f"{lead}long {name} = {v};", f'{lead}"{name}": {v},', f"{lead}{name}: {v}", f"{name}={value}"]
        if not quoted:
            kinds = [f"{name}={value}", f"{name} = {value}", f"{name}: {value}", f"  {name}: {value}"]
        return self.pick(kinds)

    def split(self, v: str) -> str:
        k = self.r.randint(5, max(6, len(v) - 6))
        return f'"\1{v[:k]}\2" + "\1{v[k:]}\2"'

    def positive(self) -> str:
        r = self.r
        name = self.style(self.pick(_SECRET_NAMES))
        kind = r.randrange(13)
        if kind == 12:  # letters only, or digits only
            words = self.pick(["", "-", "_", "."]).join(self.pick(_ENGLISH).title() for _ in range(r.randint(3, 4)))
            return self.assign(name, f"\1{self.pick([words, words, self.chars('0123456789', r.randint(6, 10))])}\2", True)
        if kind < 3:
            return self.assign(name, f"\1{self.phrase()}\2")
        if kind < 5:
            return self.assign(name, f"\1{self.opaque()}\2")
        if kind == 5:
            return self.assign(name, "", True).replace('""', self.split(self.opaque()))
        if kind == 6:
            who = self.pick(["", self.pick(["const ", "var ", "auto ", "let "])])
            url = f"{self.pick(['amqp', 'https', 'postgres', 'mongodb', 'redis', 'mysql', 'ftp', 'http'])}://{self.word()}:\1{self.phrase()}\2@{self.word()}.{self.word()}.{self.pick(['test', 'invalid', 'example'])}{self.pick(['', f':{r.randint(1000, 9999)}'])}/{self.word()}"
            return self.pick([f'{who}{self.word()}_{self.pick(["url", "dsn", "uri", "target"])} = "{url}"', f"{self.ident()}: {url}", f"{self.ident().upper()}={url}", f"// see {url}"])
        if kind == 7:
            head = self.pick(["requestHeader", "request_header", "setHeader", "headers.set"])
            return f'    {head}("Authorization", "{self.pick(["Bearer", "Bearer", "Token"])} \1{self.opaque()}\2"){self.pick(["", ";"])}'
        if kind == 8:
            b = base64.b64encode(f"{self.word()}:{self.phrase()}".encode()).decode()
            return f'    {self.pick(["requestHeader", "request_header"])}("Authorization", "Basic \1{b}\2"){self.pick(["", ";"])}'
        if kind == 9:
            return f'    {self.pick(["login", "basic_auth", "basicAuth", "authenticate"])}("{self.word()}", "\1{self.phrase()}\2"){self.pick(["", ";"])}'
        if kind == 10:
            mark = self.pick(["//", "#", " *"])
            v = self.pick([self.known(), self.phrase(), self.opaque()])
            return self.pick([f"{mark} {self.pick(['pw', 'password', 'token', 'key', 'pass'])}{self.pick(['=', ': '])}\1{v}\2", f"{mark} login {self.word()} / \1{self.phrase()}\2", f"{mark} {self.pick(['user', 'account'])} {self.word()} / \1{self.phrase()}\2", f"{mark} TODO remove {self.pick(['token', 'password'])} \1{v}\2", f"{mark} {self.pick(['old', 'new', 'the', 'current', 'test'])} {self.pick(['key', 'password', 'token', 'secret', 'pw'])} {self.pick(['was', 'is', 'for staging is'])} \1{v}\2{self.pick(['', ', rotate it', ' until friday', '.'])}", f"{mark} ask {self.word()} first, {self.pick(['pass', 'pw', 'the password', 'token', 'key'])} is \1{v}\2", f"{mark} {self.pick(['staging', 'test', 'old', 'prod', 'local'])} {self.pick(['password', 'token', 'key'])}{self.pick([': ', ' = ', ' '])}\1{v}\2"])
        return self.pick([
            self.assign(self.ident(), f"\1{self.known()}\2"), f'    {self.ident()}("\1{self.jwt()}\2"){self.pick(["", ";"])}', self.assign(self.ident(), f"\1{self.jwt()}\2"),
            f'{self.ident()} = {self.pick(["", chr(34), chr(34) * 3, "`"])}\1-----BEGIN {self.pick(["", "RSA ", "EC ", "OPENSSH "])}PRIVATE KEY-----\2{self.pick(["", chr(92) + "n" + self.chars(_B64, 64) + chr(92) + "n" + self.chars(_B64, 64)])}', f"\1-----BEGIN {self.pick(['', 'RSA ', 'EC '])}PRIVATE KEY-----\2",
        ])

    def negative(self) -> str:
        r, c = self.r, self.chars
        name, kind = self.ident(), min(r.randrange(19), 17)
        benign = f"{self.word()}_{self.pick(['checksum', 'sha', 'hash', 'digest', 'id', 'uuid', 'etag', 'md5', 'integrity'])}"
        hexed = c("0123456789abcdef", self.pick([32, 40, 64]))
        if kind == 0:
            return self.assign(self.style(benign), hexed)
        if kind == 1:
            h = c("0123456789abcdef", 32)
            return self.assign(self.style(self.pick([benign, f"{self.word()}_id", name])), f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}")
        if kind == 2:
            return self.assign("integrity", f"sha{self.pick(['256', '384', '512'])}-{c(_B64, 64)}")
        if kind == 3:
            return self.assign(self.style(f"{self.word()}_icon"), f"data:image/png;base64,{c(_B64, r.randint(60, 200))}")
        if kind == 4:
            return self.assign(self.style(f"{self.word()}_data"), c(_B64, r.randint(120, 900)))
        if kind in (5, 6):
            hold = self.pick(["changeme", "********", "YOUR_API_KEY", "<your-token>", "<set me>", "TODO", "xxxxxxxxxxxx", "${API_TOKEN}", "${VAULT_REF}", "null", "", "example", "dummy", "not-a-real-key", "from-env", "password", "your-password-here", "abc123", "${" + self.word().upper() + "_KEY}"])
            return self.assign(self.style(self.pick(_SECRET_NAMES)), hold)
        if kind == 7:
            return f'    {self.style(self.pick(_SECRET_NAMES))} = {self.pick(["read_env", "readEnv", "getenv", "os.environ.get", "vault.read"])}("{self.pick(_SECRET_NAMES).upper()}")'
        if kind == 8:
            return self.pick([f'    request_header("Authorization", "Bearer " + {self.pick(["session_token", "sessionToken", "token"])})', f'    requestHeader("{self.pick(["X-Request-Id", "ETag", "If-Match"])}", "{hexed}");'])
        if kind == 9:
            return self.assign(self.style(self.pick(["db_url", f"{self.word()}_url", "base_url"])), self.pick([f"postgres://{self.word()}:${{DB_PASS}}@{self.word()}.{self.word()}.example:5432/{self.word()}", f"https://{self.word()}.{self.word()}.example/{self.word()}?page={r.randint(1, 99)}", f"https://{self.word()}.{self.word()}.test:{r.randint(1000, 9999)}/{self.word()}", f"git@{self.word()}.example:{self.word()}/{self.word()}.git"]))
        if kind == 10:
            return self.assign(self.pick(["public_key", "publicKey", "PUBLIC_KEY"]), "-----BEGIN PUBLIC KEY-----" + self.pick(["", "\\n" + c(_B64, 64) + "\\n-----END PUBLIC KEY-----"]))
        if kind == 11:
            about = self.style(f"{self.pick(['token', 'key', 'password', 'secret', 'session'])}_{self.word()}")
            return self.assign(about, self.pick([str(r.randint(1, 9999)), f"{self.word()}/{self.word()}", self.word(), "true", f"https://{self.word()}.{self.word()}.test/{self.word()}", f"{self.word()}-{r.randint(1, 999)}"]))
        if kind == 12:
            return self.assign(self.style(f"{self.word()}_{self.pick(['token', 'key'])}"), self.pick([str(r.randint(1, 9999)), self.word(), f"{self.word()}/{self.word()}", "true"]))
        if kind == 13:
            return f"    {self.ident()} = {self.ident()}({self.ident()}({self.ident()}.{self.ident()} + {r.randint(1, 9999)}, {r.randint(1, 99)}), {self.ident()})"
        if kind == 14:
            return self.pick([f' * Turns {self.word()} names into {self.word()} keys, for example "{self.word()}-{r.randint(1, 999)}".', f"// same limit as the {self.word()} ({r.randint(1, 999)})", f"# {self.word()} {r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)} - Apache-2.0 licensed", f"// part of {self.word()}, version {r.randint(1, 9)}.{r.randint(1, 9)}", f"{self.pick(['//', '#', ' *', '/*!'])} @license {self.word()} {r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)} {self.pick(['MIT', 'Apache-2.0', 'BSD-3-Clause', 'ISC', 'GPL-3.0', 'MPL-2.0'])}", f"{self.pick(['//', '#', ' *', '/*!'])} {self.word().title()} ({self.pick(['Apache-2.0', 'BSD-3-Clause'])}), release {r.randint(1, 9)}.{r.randint(1, 9)}.0, copied from upstream", f"{self.pick(['//', '#'])} SPDX-License-Identifier: {self.pick(['Apache-2.0', 'BSD-3-Clause', 'GPL-3.0'])}", f"{self.pick(['//', '#', '/*'])} Generated from {self.word()}.schema, source hash {c('0123456789abcdef', self.pick([8, 12, 40]))}", f"{self.pick(['//', '#'])} see commit {c('0123456789abcdef', self.pick([7, 8, 12, 40]))}", "// the password comes from the vault", f"# rotate the token every {r.randint(10, 90)} days"])
        if kind == 17:  # names of secrets in the place of secrets, and the forms of secrets under other names
            words = self.pick(["", "-", "_"]).join(self.pick(_ENGLISH).title() for _ in range(r.randint(3, 4)))
            named = self.style(self.pick([*_SECRET_NAMES, *[f"{self.word()}_{x}" for x in ("token", "token", "key", "secret", "password")]]))
            lead = " " * r.choice((0, 2, 4, 8)) + self.pick(["", "", "const ", "var ", "auto ", "let "])
            of, end = self.pick([" = ", " = ", " := ", ": ", " == "]), self.pick(["", ";"])
            if r.random() < 0.15:  # descriptions
                return f"{self.pick(['//', '#', ' *', '///'])} {named}: {self.word().title()} {' '.join(self.word() for _ in range(r.randint(2, 6)))}{self.pick(['', f' {r.randint(1, 999)} times', ' by hand'])}."
            if r.random() < 0.6:  # expressions
                return f"{lead}{named}{of}" + self.pick([
                    f"{self.ident()}.{self.ident()}({self.ident()})", f"{self.ident()}.{self.ident()} {self.pick('+-*')} {r.randint(1, 999)}", f"{self.ident()}({self.ident()}.{self.ident()} - {r.randint(1, 999)}, {r.randint(1, 99)})", f"{self.ident()}.{self.ident()}", f"{self.ident()}({self.ident()})", self.ident(), f"{self.ident()}.{self.ident()}({self.ident()}.{self.ident()})",
                    f"{self.ident()}[{self.ident()}]", f"{self.ident()} * {r.randint(1, 9999)}", f"{self.ident()}({self.ident()}({self.ident()}.{self.ident()} + {r.randint(1, 9999)}, {r.randint(1, 99)}), {self.ident()})",
                ]) + end
            return self.pick([
                self.assign(named, self.pick([f"{self.word()}{self.word().title()}", f"{self.word()}_{self.word()}", self.style(self.pick(_SECRET_NAMES))]), r.random() < 0.5), self.assign(name, self.pick([words, self.chars("0123456789", r.randint(6, 10))]), True),
                self.assign(self.style(f"{self.pick(['token', 'key', 'password'])}_{self.word()}"), words, True), f"    {named} = {self.ident()}({self.ident()}, {r.randint(0, 9)})", f"{self.pick(['//', '#', ' *'])} the {self.pick(['token', 'key', 'password', 'login'])} of the {self.word()}: see {self.word()}",
                f"    {self.pick(['return', 'if', 'await'])} {self.ident()}({named}): {self.word()}", f'    {self.ident()}["{named}"] = {self.ident()}', f"func {self.style('get_' + self.word())}({named}: {self.word().title()}) -> {self.word().title()} {{",
            ])
        if kind == 15:
            return f"function {self.pick('abcdef')}(s,x){{var e=s.{self.word()},n=0;for(;n<x;n++)e[s]^={r.randint(1, 99)};return e?x:b(s-1,x)}}var e=function(r){{return r&&r.length>{r.randint(1, 99)}?r.slice({r.randint(1, 9)}):\"{self.word()}\"}};"
        if r.random() < 0.5:
            w, x, d = self.word(), self.word(), r.randint(0, 60)
            return self.pick([f"export const {w.title()}Msg_{x.title()}_{d}: number = {r.randint(0, 60)};", f"#define {w.upper()}MSG_{x.upper()}_{d} {d}", f"pub const {w.upper()}MSG_{d}: Entry = Entry {{ id: {d}, kind: 3 }};", f"proto.{w.title()}Msg.prototype.get{x.title()}{d} = function() {{ return this.f{d}; }};", f"{w.upper()}_{x.upper()}{d} = {self.ident()}({d})", f"self.{w}_{x}{d} = {w}{d}.{x}_{d}", f'{w}{d} = {x}_{w}("{x}_{d}", {w}{d})', f"var {w}{d}: {x.title()}{d} = {w.title()}_{x.title()}_{d};"])
        return self.pick([", ".join(str(r.randint(0, 65535)) for _ in range(12)) + ",", ", ".join(f"0x{c('0123456789abcdef', 2)}" for _ in range(12)), f'{self.ident()} = "{self.word()}.{self.word()}{r.randint(1, 99)}"', f'_{self.word().upper()}MSG_FIELD_{r.randint(0, 9)} = _Descriptor(name=\'{self.word()}\', number={r.randint(1, 20)}, kind={r.randint(1, 12)})', f"public long get{self.word().title()}{r.randint(0, 9)}() {{ return f{r.randint(0, 9)}; }}", c(_B64, 64)])


def training_lines(n: int = TRAINING_LINES, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """(line, spans of the pieces of its credential), half of them with one."""
    w, out = _Writer(seed), []
    for i in range(n):
        line, spans, text = w.positive() if i % 2 else w.negative(), [], ""
        for part in re.split("(\1[^\2]*\2)", line):
            if part.startswith("\1"):
                spans.append((len(text), len(text) + len(part) - 2))
                part = part[1:-1]
            text += part
        out.append((text, spans))
    return out


def _labels(spans: list[tuple[int, int]], gold: list[tuple[int, int]]) -> list[int]:
    out, begun = [], False
    for a, b in spans:
        inside = any(s < b and a < e for s, e in gold)
        if inside:
            out.append(PIECE if begun else BEGIN)
            begun = True
        else:
            out.append(BETWEEN if begun and gold and a < gold[-1][0] else OUT)
    return out


_MODEL: list[Crf] = []


def model() -> Crf:
    """The field, trained once in each process that asks for it; the seeds fix the result."""
    if not _MODEL:
        data = []
        for line, gold in training_lines():
            spans, features = featured(line)
            if features:
                data.append((features, _labels(spans, gold)))
        _MODEL.append(Crf(4).fit(data))
    return _MODEL[0]


def candidate_lines(text: str) -> list[tuple[int, int]]:
    """Where the lines begin and end that can hold a credential."""
    out = set()
    for m in _DIGIT_LINE.finditer(text):
        for run in _RUN.finditer(text, m.start(), m.end()):
            w = run[0]
            if not w.isalpha() and not w.isdigit() and any(c.isdigit() for c in w) and any(c.isalpha() for c in w):
                out.add(m.span())
                break
    for rule in (_SCHEME, _NAMED):
        for m in rule.finditer(text):
            end = text.find("\n", m.end())
            out.add((text.rfind("\n", 0, m.start()) + 1, len(text) if end < 0 else end))
    return sorted(out)


_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
#: Longer lines are decoded in overlapping windows of so many tokens, so that the tables of the field stay small; their features come from the whole line.
WINDOW, OVERLAP = 800, 160


def find_all(texts: list[str | None], field: Crf) -> list[list[list[tuple[int, int]]]]:
    """For every text its credentials, each as the spans of its pieces."""
    jobs, features, spans = [], [], []
    for k, text in enumerate(texts):
        for a, b in candidate_lines(text or ""):
            s, f = featured(text[a:b].rstrip("\r"))
            for at in range(0, max(1, len(f) - OVERLAP), WINDOW - OVERLAP):
                if f:
                    jobs.append((k, a))
                    spans.append(s[at : at + WINDOW])
                    features.append(f[at : at + WINDOW])
    out: list[list[list[tuple[int, int]]]] = [[] for _ in texts]
    for (k, at), s, labels in zip(jobs, spans, field.decode(features)):
        now = None
        for (a, b), label in zip(s, labels):
            if label == BEGIN or label == PIECE and now is None:
                now = [(at + a, at + b)]
                out[k].append(now)
            elif label == PIECE:
                now.append((at + a, at + b))
            elif label == OUT:
                now = None
    for k, text in enumerate(texts):
        done, kept = -1, []
        for found in sorted(out[k]):
            a, b = found[0]
            if text.startswith("-----BEGIN", a):
                end = _END.search(text, b)
                stop = text.find("-----", b)
                found = [(a, end.start() if end and (stop < 0 or end.start() <= stop + 1) else stop if stop > 0 else len(text))]
                b = found[0][1]
            if a >= done:
                kept.append(found)
                done = max(b, found[-1][1])
            elif found[-1][1] > done:  # the edge of a window cut what was kept
                kept[-1] = kept[-1] + [(max(x, done), y) for x, y in found if y > done]
                done = found[-1][1]
        out[k] = kept
    return out


def mask(text: str, credentials: list[list[tuple[int, int]]]) -> str:
    """The text with the characters of its credentials masked; the marks of a private key and all white space stay."""
    parts, at = [], 0
    for a, b in sorted(s for c in credentials for s in c):
        if text.startswith("-----BEGIN", a):
            a = text.index("-----", a + 5) + 5
        parts += [text[at:a], re.sub(r"\\n|(\S)", lambda m: MASK if m[1] else m[0], text[a:b])]
        at = b
    return "".join(parts) + text[at:]


def _chunk_texts(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("chunk_no").isNotNull() & F.col("text").isNotNull()).select("chunk_no", "text")


def in_chunks(chunks: DataFrame) -> DataFrame:
    """(holder, holder_no, place_no): the line of every credential in every chunk."""
    field = chunks.sparkSession.sparkContext.broadcast(_compact(model()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = _full(field.value)
        for pdf in batches:
            texts = pdf["text"].tolist()
            rows = {(no, text.count("\n", 0, c[0][0]) + 1) for no, text, found in zip(pdf["chunk_no"], texts, find_all(texts, crf)) for c in found}
            yield pd.DataFrame(sorted(rows), columns=["holder_no", "place_no"])

    found = _chunk_texts(chunks).mapInPandas(run, "holder_no bigint, place_no bigint").distinct()
    return found.select(F.lit("chunk").alias("holder"), "holder_no", "place_no")


def masked_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_no, n_credentials, text) with the credentials masked."""
    field = chunks.sparkSession.sparkContext.broadcast(_compact(model()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = _full(field.value)
        for pdf in batches:
            texts = pdf["text"].tolist()
            found = find_all(texts, crf)
            yield pd.DataFrame({"chunk_no": pdf["chunk_no"], "n_credentials": [len(f) for f in found], "text": [mask(t, f) for t, f in zip(texts, found)]})

    return _chunk_texts(chunks).dropDuplicates(["chunk_no"]).mapInPandas(run, "chunk_no bigint, n_credentials int, text string")


def _compact(crf: Crf) -> tuple:
    """Weights of the features that were seen, a bounded table whatever the corpus."""
    used = np.flatnonzero(np.abs(crf.w).max(1) > 1e-6)
    return used.astype(np.int32), crf.w[used].astype(np.float32), crf.t


def _full(parts: tuple) -> Crf:
    crf = Crf(len(parts[2]))
    crf.w[parts[0]], crf.t = parts[1], parts[2]
    return crf


def source_of(nodes: list[dict]) -> bytearray:
    """The bytes of a file as far as the texts of its nodes tell them; a gap of one is a space, others are line ends.

    A text that was cut tells the bytes before its dots where no other node does.
    """
    size = max((n["end_byte"] for n in nodes if isinstance(n.get("end_byte"), int)), default=0)
    out, known, cut = bytearray(b"\n" * size), bytearray(size), []
    for n in nodes:
        text, a, b = n.get("text"), n.get("start_byte"), n.get("end_byte")
        if isinstance(text, str) and isinstance(a, int) and isinstance(b, int) and a >= 0:
            raw = text.encode("utf-8", "surrogatepass")
            if len(raw) == b - a:
                out[a:b], known[a:b] = raw, b"\1" * len(raw)
            elif len(raw) < b - a and text.endswith("..."):
                cut.append((a, raw[:-3]))
    for a, raw in cut:
        for m in re.finditer(rb"\x00+", bytes(known[a : a + len(raw)])):
            out[a + m.start() : a + m.end()], known[a + m.start() : a + m.end()] = raw[m.start() : m.end()], b"\1" * (m.end() - m.start())
    for m in re.finditer(rb"(?<=\x01)\x00(?=\x01)", bytes(known)):
        out[m.start()] = 32
    return out


def _in_tree(root: dict, crf: Crf) -> tuple[list[dict], list[int]]:
    """The nodes of a tree and the preorder numbers of the deepest nodes that hold its credentials."""
    nodes = nested.walk(root)[0]
    raw = bytes(source_of(nodes))
    text = raw.decode("latin-1")  # one character a byte, so that offsets agree
    spans = np.array([(n.get("start_byte") if isinstance(n.get("start_byte"), int) else -1, n.get("end_byte") if isinstance(n.get("end_byte"), int) else -1) for n in nodes])
    out = set()
    for found in find_all([text], crf)[0]:
        a, b = found[0]
        if text.startswith("-----BEGIN", a):
            b = text.index("-----", a + 5) + 5
        holds = np.flatnonzero((spans[:, 0] <= a) & (spans[:, 1] >= b))
        if not len(holds):
            holds = np.flatnonzero((spans[:, 0] <= a) & (spans[:, 1] > a))
        if len(holds):
            out.add(int(holds[-1]))
    return nodes, sorted(out)


def in_trees(records: DataFrame) -> DataFrame:
    """(holder, holder_no, place_no): the deepest node of every credential in every file's valid record."""
    field = records.sparkSession.sparkContext.broadcast(_compact(model()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = _full(field.value)
        for pdf in batches:
            rows = []
            for file_id, text in zip(pdf["file_id"], pdf["cst_json"]):
                root = nested.load_root(text)
                if root is not None:
                    rows += [(file_id, pre) for pre in _in_tree(root, crf)[1]]
            yield pd.DataFrame(rows, columns=["holder_no", "place_no"])

    found = nested.valid_records(records).mapInPandas(run, "holder_no bigint, place_no bigint")
    return found.select(F.lit("node").alias("holder"), "holder_no", "place_no")


def masked_nodes(records: DataFrame) -> DataFrame:
    """(file_id, pre, text): the texts of all nodes of the valid records that hold a credential or a part of one, masked; cut texts stay cut."""
    field = records.sparkSession.sparkContext.broadcast(_compact(model()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = _full(field.value)
        for pdf in batches:
            rows = []
            for file_id, record in zip(pdf["file_id"], pdf["cst_json"]):
                root = nested.load_root(record)
                if root is None:
                    continue
                nodes = nested.walk(root)[0]
                text = bytes(source_of(nodes)).decode("latin-1")
                found = find_all([text], crf)[0]
                if not found:
                    continue
                clean = mask(text, found).encode("latin-1")
                hidden = np.flatnonzero(np.frombuffer(clean, np.uint8) != np.frombuffer(text.encode("latin-1"), np.uint8))
                for pre, n in enumerate(nodes):
                    a, b = n.get("start_byte"), n.get("end_byte")
                    if isinstance(n.get("text"), str) and isinstance(a, int) and isinstance(b, int):
                        raw = bytearray(n["text"].encode("utf-8", "surrogatepass"))
                        within = hidden[(hidden >= a) & (hidden < min(b, a + len(raw) - 3 * (len(raw) != b - a)))]
                        if len(within):
                            for at in within.tolist():
                                raw[at - a] = clean[at]
                            rows.append((file_id, pre, raw.decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["file_id", "pre", "text"])

    return nested.valid_records(records).mapInPandas(run, "file_id bigint, pre bigint, text string")
