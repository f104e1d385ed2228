"""Credentials in source code, configuration and URLs.

Strings are judged by characters per subword under a public tokenizer vocabulary: natural text has about four, random
strings hardly two. The score is combined with context rules: what the string is assigned to (a key that ends in
password, token, api key, ... or only in key), authorization headers, user information of URLs, command line options,
known token formats, fallback values of placeholders, strings in pieces, encoded strings. References to other places,
placeholders, masks, digests, public keys and certificates are no credentials.

Masking keeps every offset: each character of the value that isn't a line break becomes an asterisk, in all pieces,
so the surrounding code stays as it was.

Defined results: null and blank texts have none; positions are code points from 0; of overlapping finds the earlier,
then the longer one stays; a repeated or redelivered row gives each credential once; whole texts are read.
"""

from __future__ import annotations

from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.spans import map_rows
from factloom.llm.tokens import DEFAULT_VOCAB, encoding

#: Characters per subword below which a string is unnatural; judged on strings of at least MIN_CHARS.
UNNATURAL, MIN_CHARS = 2.6, 8

STRONG_LAST = frozenset("password passwd passphrase passwort kennwort pwd pass pw secret token sig signature apikey senha contraseña contrasena authtoken accesstoken sharedkey clientsecret dbpass pswd".split())
STRONG_PAIR = frozenset(("api", "access", "secret", "shared", "private", "auth", "hmac", "signing", "encryption", "account", "storage", "tls", "master", "service", "subscription"))
STRONG_TAIL = ("password", "passwd", "passphrase", "kennwort", "passwort", "secret", "apikey", "sharedkey", "accesskey", "authtoken", "accesstoken", "secretkey", "privatekey")
WEAK_LAST = frozenset("key auth credential credentials cred creds code hash bearer".split())
_PARTS = regex.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zà-ÿ]+|\d+")


@lru_cache(maxsize=65_536)
def strength(name: str) -> int:
    """2 if a key of this name holds a credential, 1 if it may, else 0."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    while parts and parts[-1].isdigit():
        parts.pop()
    if not parts:
        return 0
    last = parts[-1]
    if last in STRONG_LAST or last.endswith(STRONG_TAIL) or (last == "key" and len(parts) > 1 and parts[-2] in STRONG_PAIR):
        return 2 if not (last in ("sig", "signature") and len(parts) == 1) else 1
    return 1 if last in WEAK_LAST else 0


class Judge:
    """Characters per subword of a vocabulary."""

    def __init__(self, vocab: str):
        self.vocab = vocab

    def per_subword(self, s: str) -> float:
        n = len(encoding(self.vocab).encode_ordinary(s))
        return len(s) / n if n else 0.0

    def unnatural(self, s: str) -> bool:
        return len(s) >= MIN_CHARS and self.per_subword(s) < UNNATURAL

    def stated(self, s: str) -> bool:
        """Whether a part of the string is one that nobody writes as a word: letters with digits in between, or unnatural."""
        parts = [x for x in regex.split(r"[\s_\-./:]+", s) if x]
        return any(len(x) >= 4 and any(c.isdigit() for c in x) and any(c.isalpha() for c in x) or self.unnatural(x) for x in parts)

    def placeholder(self, s: str) -> bool:
        """Whether the string only stands for a value: a template, a mask, a reference, or words that say so.

        What follows such words decides: your-token-here stands for a value, test-9f8a7dQx2 is one.
        """
        t = s.strip()
        if not t or _TEMPLATE.match(t) or t.startswith(("sha256:", "sha512-", "sha1:", "md5:", "SHA256:")):
            return True
        if regex.fullmatch(r"[A-Z]+(?:_[A-Z]+)+", t) and strength(t) == 2:
            return True  # the name of a variable that holds one
        if m := _LEAD.match(t):
            return not m["rest"] or not self.stated(m["rest"])
        if m := _CALL.match(t):
            inner = m["inner"].rstrip()
            return inner.endswith((")", "]", ");", "];")) or not inner or bool(regex.fullmatch(r"[\"'$]?[A-Za-z_][\w.]*[\"',]?", inner)) and not self.stated(inner)
        if _PATH.match(t):
            return True
        m = _PREFIX.match(t)
        return bool(m) and (any(c in m["rest"] for c in "/.#:@") or not self.stated(m["rest"]))

    def secret(self, s: str, level: int) -> bool:
        """Whether a literal assigned to a key of this strength is a credential."""
        if self.placeholder(s):
            return False
        if level == 2:
            if len(s) < 4:
                return False
            mixed = any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
            return mixed or self.unnatural(s) or (len(s) >= 6 and bool(regex.search(r"[!#@$%^*]", s)))
        return len(s) >= 12 and self.unnatural(s) and any(c.isdigit() for c in s) and any(c.isalpha() for c in s)

    def word(self, s: str) -> bool:
        """Whether a literal that is given as a password may be a plain word."""
        parts = [x.lower() for x in regex.split(r"[^\p{L}]+", regex.sub(r"(?<=\p{Ll})(?=\p{Lu})", " ", s)) if x]
        return len(s) >= 4 and bool(regex.fullmatch(r"[\p{L}_\-.]+", s)) and not regex.fullmatch(r"[A-Z]+(?:_[A-Z]+)+", s) and not self.placeholder(s) and not any(x in _NO_PASSWORD for x in parts)


#: Templates, masks and empty values.
_TEMPLATE = regex.compile(
    r"^(?:[$#%]?\{\{?.*|\$\(.*|<[^<>]*>|%[A-Za-z_]+%|\$[A-Za-z_][\w.\->]*(?:[\[(].*)?|@[A-Za-z_]+@|__\w+__|\[.*\]|(.)\1{3,}|[*•xX.\-_?#]+|null|none|nil|true|false|undefined|string|int|required|optional)$", regex.I | regex.S
)
#: Words that announce a stand-in; what follows them is judged by itself.
_LEAD = regex.compile(
    r"^(?:your|my|the|some|example|sample|dummy|test|fake|change|replace|insert|enter|todo|redacted|masked|hidden|secret|placeholder)[\s_\-]?(?:me|this|here|it|value|token|key|secret|password|pass|api[_-]?key)?(?:[\s_\-](?P<rest>.*))?$", regex.I | regex.S
)
#: Calls and lookups; members of objects; addresses in other stores.
_CALL = regex.compile(r"^[A-Za-z_]\w*(?:\.\w+)*[\(\[](?P<inner>.*)$", regex.S)
_PATH = regex.compile(r"^(?:os|process|System|config|settings|env|secrets|self|this|ctx|viper|vault|props|args|params|request|req)(?:\.[A-Za-z_]\w*)+$|^(?:vault|ssm|kms|arn|secretsmanager|op|sops|gcp-sm|azurekv|keyvault|consul)[:/].*", regex.I | regex.S)
_PREFIX = regex.compile(r"^(?:env|ref|file)[:/](?P<rest>.*)$", regex.I | regex.S)
#: Keys whose value may be a plain word, and words that are none.
_PASSWORD_LAST = frozenset("password passwd passphrase passwort kennwort pwd pass pw senha contraseña contrasena dbpass pswd".split())
_NO_PASSWORD = frozenset(
    "password passwd passphrase passwort kennwort pwd pass senha contraseña secret token key credential credentials user username login auth api value text field input hash plain basic type name label hint "
    "string str number integer int bool boolean object array null none nil true false undefined required optional default empty blank missing invalid incorrect wrong expired weak reset forgot hidden masked redacted".split()
)


def _password(name: str) -> bool:
    parts = [p.lower() for p in _PARTS.findall(name) if not p.isdigit()]
    return bool(parts) and (parts[-1] in _PASSWORD_LAST or parts[-1].endswith(("password", "passwd", "passphrase", "kennwort", "passwort")))


_PEM = regex.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----BEGIN)[\s\S])*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----[A-Za-z0-9+/=\s\\nr]*")
#: Formats of issued tokens; fixed values.
_ISSUED = regex.compile(
    r"(?<![A-Za-z0-9_\-])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[A-Za-z0-9_\-]{16,}|xox[abeoprs]-[A-Za-z0-9\-]{10,}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_\-]{20,}|npm_[A-Za-z0-9]{20,}|"
    r"SG\.[\w\-]{16,}\.[\w\-]{16,}|AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|AIza[\w\-]{30,}|ya29\.[\w\-]{20,}|pypi-[\w\-]{16,}|dckr_pat_[\w\-]{16,}|hvs\.[\w\-]{20,}|shpat_[0-9a-f]{20,}|eyJ[\w\-]{8,}\.eyJ[\w\-]{4,}\.[\w\-]{8,})"
)
_HEADER = regex.compile(r"\b(?:Bearer|Basic|Token|ApiKey|Digest|Negotiate)\s+([A-Za-z0-9._~+/\-]{8,}=*)", regex.I)
_USERINFO = regex.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://([^\s:/@\"'`<>?#${}]*)(?::((?:\$\{[^{}]*\}|[^\s/@\"'`<>{}$])+))?@(?=[\w${\[])")
_DEFAULT = regex.compile(r"\$\{([A-Za-z_][\w.\-]*)\s*:[\-=]?([^{}$]+)\}")
_ASSIGN = regex.compile(
    r"(?<![A-Za-z0-9_])([A-Za-z_]\w*+)" + r"[\"'\]]{0,2}\s*(?::=|=>|[:=])\s*(?:(?:(?:[\w.]*(?:fromhex|fromHex|decode|decode64|unhexlify|from|bytes|encode|getBytes|str|String|Some|Secret|SecretStr|quote))\(\s*)?(?:[brufL@]{0,2})(?P<q>[\"'`])(?P<v>(?:\\.|(?!(?P=q))[^\n\\])*)(?P=q)?|(?P<u>[^\s\"'`<>,;&{}|]{1,1024}))", regex.S
)
#: A line of an environment file.
_LINE = regex.compile(r"^[ \t]*(?:export[ \t]+)?[A-Z][A-Z0-9_]*$", regex.M)
_REST = regex.compile(r"[^\s\"'`<>,;&{}|]*")
_ATTR = regex.compile(r"(?:name|key|id)\s*=\s*[\"']([\w.\-]+)[\"']\s+value\s*=\s*([\"'])((?:(?!\2).)*)\2", regex.I)
_SQL = regex.compile(r"\b(?:IDENTIFIED\s+(?:WITH\s+\w+\s+)?BY|PASSWORD)\s+(['\"])((?:(?!\1).)+)\1", regex.I)
_CLI = regex.compile(r"(?:^|\s)(?:-u|--user)[ =][\"']?[\w.\-]+:([^\s\"'@:]+)|(?:^|\s)(?:mysql|mysqldump|mysqladmin|mariadb)\b[^|;\n]*?\s-p([^\s\"']+)|(?:^|\s)(?:sshpass|plink|pscp)\s+-p\s*[\"']?([^\s\"']+)|(?:^|\s)--?(?:password|passwd|pass|token|secret|api-key|apikey)[ =][\"']?([^\s\"'\-][^\s\"']*)", regex.I)
_PIECES = regex.compile(r"([\"'])((?:(?!\1)[^\n\\])*)\1(?:\s*(?:(?:\+|\.|\\\n|\|\|)\s*)?([\"'])((?:(?!\3)[^\n\\])*)\3)+")
_PIECE = regex.compile(r"([\"'])((?:(?!\1)[^\n\\])*)\1")
_DIGEST = regex.compile(r"(?:sha(?:1|256|384|512)|md5|digest|integrity|etag|checksum|commit|uuid|fingerprint|revision|build|trace)[\w\"']*\s*[:=@\-]?\s*[\"']?$", regex.I)
_REMARK = regex.compile(r";?[ \t]*(?://|#|/\*|--)[^\n]*")
_MEANT = regex.compile(r"api[ _\-]?key|password|passwd|secret|token|passphrase|credential|private key|kennwort|senha|contraseña", regex.I)



def _named(text: str, at: int) -> str | None:
    """The name that a value which begins here is assigned to."""
    i = at
    while i and (text[i - 1].isspace() or text[i - 1] == "("):
        i -= 1
    if text[i - 2 : i] in (":=", "=>"):
        i -= 2
    elif i and text[i - 1] in ":=":
        i -= 1
    else:
        return None
    while i and text[i - 1].isspace():
        i -= 1
    while i and text[i - 1] in "\"']":
        i -= 1
    return _back(text, i) or None


def _back(text: str, end: int, parts: int = 3) -> str:
    """The dotted or hyphened name that ends here, as many parts of it as its strength can depend on."""
    i = end
    while i and (text[i - 1].isalnum() or text[i - 1] in "_.-"):
        i -= 1
        if text[i] in ".-":
            parts -= 1
            if not parts:
                return text[i + 1 : end]
    return text[i:end]


def _nearby(text: str, lo: int, hi: int) -> str:
    """The statement around lo..hi outside of strings, with the comment behind it."""
    a, b = lo, hi
    while a and text[a - 1] not in "\n;{}\"'":
        a -= 1
    while b < len(text) and text[b] not in "\n;\"'":
        b += 1
    if m := _REMARK.match(text, b):
        b = m.end()
    return text[a:lo] + " " + text[hi:b]


Find = tuple[int, int, tuple[tuple[int, int], ...]]


def find(text: str | None, judge: Judge) -> list[Find]:
    """(start, end, pieces) of each credential in a text."""
    if not text or not text.strip():
        return []
    out: list[Find] = []

    def add(lo: int, hi: int, pieces=None) -> None:
        out.append((lo, hi, tuple(pieces or ((lo, hi),))))

    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            add(m.start(), m.end())
    for m in _ISSUED.finditer(text):
        if judge.per_subword(m[0]) < 3.2:
            add(m.start(), m.end())
    for m in _HEADER.finditer(text):
        v = m[1]
        if (judge.unnatural(v) or any(c.isdigit() for c in v) and len(v) >= 16) and not judge.placeholder(v):
            add(m.start(1), m.end(1))
    if "://" in text:
        for m in _USERINFO.finditer(text):
            if m[2] is None:
                if m[1] and len(m[1]) >= 16 and judge.unnatural(m[1]):
                    add(m.start(1), m.end(1))
            elif not m[2].startswith("${") and judge.secret(m[2], 2):
                add(m.start(2), m.end(2))
    if "${" in text:
        for m in _DEFAULT.finditer(text):
            level = strength(m[1])
            if level and judge.secret(m[2].strip(), level):
                lo = m.start(2) + len(m[2]) - len(m[2].lstrip())
                add(lo, lo + len(m[2].strip()))
    pieced: list[tuple[int, int]] = []
    if "+" in text or "\\\n" in text or regex.search(r"[\"']\s+[\"']", text):
        for m in _PIECES.finditer(text):
            parts = [(p.start(2), p.end(2)) for p in _PIECE.finditer(text, m.start(), m.end()) if p[2]]
            whole = "".join(text[a:b] for a, b in parts)
            if len(parts) < 2 or "+" not in m[0] and "\n" not in m[0]:
                continue
            named = _named(text, m.start())
            level = strength(named) if named else 0
            if level < 2 and _MEANT.search(_nearby(text, m.start(), m.end())):
                level = 2
            if level and regex.fullmatch(r"[\w+/=.\-!@#$%^&*~]+", whole) and judge.secret(whole, level) and (level == 2 or judge.unnatural(whole)):
                add(parts[0][0], parts[-1][1], parts)
                pieced.append((m.start(), m.end()))
    done = 0
    for m in _ASSIGN.finditer(text, overlapped=True):
        name = m[1] if m.start(1) < 1 or text[m.start(1) - 1] not in ".-" else _back(text, m.end(1))
        level = strength(name)
        if not level or m.start(1) < done:
            continue
        g = "v" if m["v"] is not None else "u"
        v, lo = m[g], m.start(g)
        if any(a <= lo < b for a, b in pieced):
            continue
        if g == "u":
            v = v.rstrip(").]")
            if (m["u"].endswith(("(", "[")) or _CALL.match(m["u"])) and judge.placeholder(m["u"]):
                continue
            scheme = regex.match(r"(?:Bearer|Basic|Token)$", v, regex.I)
            if scheme or "://" in v:
                continue
        else:
            scheme = regex.match(r"(?:Bearer|Basic|Token)\s+", v, regex.I)
            if scheme or "-----BEGIN" in v or "://" in v:
                continue
            pad = len(v) - len(v.lstrip())
            lo, v = lo + pad, v.strip()
        if " " in v.strip() and not judge.unnatural(v):
            continue
        if level == 1 and (_DIGEST.search(text, max(0, m.start(1) - 20), m.end(1)) or regex.fullmatch(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f\-]{36}", v)):
            continue
        plain = level == 2 and _password(name) and (g == "v" or _LINE.match(text, text.rfind("\n", 0, m.start(1)) + 1, m.end(1))) and judge.word(v)
        if plain or judge.secret(v, level):
            done = lo + len(v)
            if g == "u" and len(m["u"]) == 1024:
                done = _REST.match(text, m.end("u")).end()  # the rest of an unusually long value
            add(lo, done)
    for m in _ATTR.finditer(text):
        if strength(m[1]) == 2 and judge.secret(m[3], 2):
            add(m.start(3), m.end(3))
    for m in _SQL.finditer(text):
        if judge.secret(m[2], 2):
            add(m.start(2), m.end(2))
    for m in _CLI.finditer(text):
        g = next(i for i in range(1, 5) if m[i] is not None)
        if judge.secret(m[g], 2):
            add(m.start(g), m.end(g))
    settled: list[Find] = []
    for s in sorted(set(out), key=lambda x: (x[0], -x[1])):
        if not settled or s[0] >= settled[-1][1]:
            settled.append(s)
    return settled


def mask(text: str, finds: list[Find]) -> str:
    """The text with the credentials' characters as asterisks; same length, line breaks and escaped ones stay."""
    out = list(text)
    for _, _, pieces in finds:
        for lo, hi in pieces:
            i = lo
            while i < hi:
                if out[i] == "\\" and i + 1 < hi and out[i + 1] in "nrt":
                    i += 2
                    continue
                if out[i] not in "\r\n":
                    out[i] = "*"
                i += 1
    return "".join(out)


def texts_of(entities: DataFrame, clients: DataFrame) -> DataFrame:
    """(table_name, record_id, field_name, item_no, text) of everything that may hold a credential."""

    def urls(df: DataFrame, table: str, key: str) -> list[DataFrame]:
        return [
            df.where(F.col(f"instance_ref.{f}").isNotNull()).select(
                F.lit(table).alias("table_name"), F.col(key).cast("string").alias("record_id"), F.lit(f"instance_ref.{f}").alias("field_name"), F.lit(0).cast("long").alias("item_no"), F.col(f"instance_ref.{f}").alias("text"))
            for f in ("resolved_url", "url_template")
        ]

    snippets = entities.select(F.col("entity_id").alias("record_id"), F.posexplode("evidence.snippet").alias("item_no", "text")).select(
        F.lit("entities").alias("table_name"), "record_id", F.lit("evidence.snippet").alias("field_name"), F.col("item_no").cast("long").alias("item_no"), "text"
    )
    df = snippets.where(F.col("text").isNotNull())
    for x in urls(entities, "entities", "entity_id") + urls(clients, "connection_clients", "client_id"):
        df = df.unionByName(x)
    return df


_KEYS = "table_name string, record_id string, field_name string, item_no long"


def credentials(texts: DataFrame, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(table_name, record_id, field_name, item_no, start_char, end_char), one row per credential."""
    judge = Judge(vocab)
    return map_rows(texts, f"{_KEYS}, start_char long, end_char long", lambda t, r, f, n, s: [(t, r, f, n, lo, hi) for lo, hi, _ in find(s, judge)]).distinct()


def redacted(texts: DataFrame, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """The same texts with only the credentials masked, and how many there are."""
    judge = Judge(vocab)

    def rows(t, r, f, n, s):
        found = find(s, judge)
        return [(t, r, f, n, mask(s, found) if found else s, len(found))]

    return map_rows(texts, f"{_KEYS}, text string, n_masked int", rows).distinct()
