"""Secrets and identifiers of machines and accounts in text: found, counted and replaced inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ASSIGNED = r"[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?"
_NO_HOLDER = r"(?![<$\[{%*])"
_HEX = "[0-9A-Fa-f]"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"[A-Za-z_][\w.-]{1,31}"


def _after(words: str, value: str, between: str = _ASSIGNED) -> tuple[str, str]:
    """What stands before a value, and the value: that of a field of such a name."""
    return rf"(?i:(?<![\w-])(?:{words}){between})", f"{_NO_HOLDER}{value}"


# Kinds in the order in which they claim text, and the public forms by which each is told; where a form
# needs something in front that is not part of the value, that stands first.
KINDS: dict[str, str | tuple[str, str]] = {
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?s:.*?)(?:-----END [A-Z ]{0,20}PRIVATE KEY-----|\z)",
    "provider_token": r"(?<!\w)(?:gh[opsur]_\w{20,}|github_pat_\w{20,}|glpat-[\w-]{20,}|AKIA[A-Z\d]{16}|sk-[\w-]{20,}|xox[abprs]-[A-Za-z\d-]{10,}"
    r"|hf_[A-Za-z\d]{30,}|AIza[\w-]{35}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]*)",
    "url_login": ("://", r"[^\s/@:]+:[^\s/@]+(?=@)"),
    "bearer_token": (r"(?i:\bbearer[ \t]{1,3})", r"[\w.~+/=-]{8,}"),
    "password": _after(r"[\w-]{0,20}(?:password|passwd|passphrase|pwd)", r"[^\s\"',;]{2,}"),
    "password_option": _after("--password|--passphrase|sshpass -p", r"[^\s\"']+", "[= ]{1,2}"),
    "secret": _after(r"[\w-]{0,20}(?:token|secret|api[_-]?key)", r"[\w./+-]{6,}"),
    "secret_zh": ("(?:密码|口令|访问令牌|密钥)(?:都是|均为|是|为|[:：= ])[ ]{0,2}", rf"{_NO_HOLDER}[^\s,，。；;]+"),
    "mac": rf"(?<![\w:-])(?:{_HEX}{{2}}(?::{_HEX}{{2}}){{5}}|{_HEX}{{2}}(?:-{_HEX}{{2}}){{5}})(?![\w:-])",
    "ipv6": rf"(?<![\w:\[,])(?<!, )(?=(?:{_HEX}{{0,4}}:){{2,7}}{_HEX}{{0,4}}(?![\w:]))(?![:0-9A-Fa-f]*::[:0-9A-Fa-f]*::)"
    rf"(?:(?:{_HEX}{{1,4}}:){{7}}{_HEX}{{1,4}}|(?=[:0-9A-Fa-f]*::)[:0-9A-Fa-f]{{3,39}})(?![\w:])",
    "ipv4": rf"(?<![\w.])(?<![=<>~^][ ]?){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)",
    "email": r"(?<![\w.+-])[A-Za-z\d][\w.+-]*@[A-Za-z\d-]+(?:\.[A-Za-z\d-]+)*\.[A-Za-z]{2,24}(?![\w-])",
    "login_at_host": r"(?<![\w.@/-])[a-z_][a-z\d_-]*@[a-z][a-z\d-]*(?![\w.@-])",
    "home_path": r"(?<![\w.])/(?:home|Users)/[\w.-]+(?:/[\w.-]+)*",
    "windows_home": (r"(?i:\b[A-Z]:[\\/]Users[\\/])", rf"{_NO_HOLDER}[^\\/\s\"']+"),
    "tilde_home": r"(?<![\w/~])~[A-Za-z_][\w.-]*",
    "login": _after("user(?:name)?|login|account|owner|uid", _NAME),
    "login_option": ("--(?:user|login)[= ]", f"{_NO_HOLDER}{_NAME}"),
    "container_command": _after("docker|podman|nerdctl", r"[A-Za-z\d][\w.-]+", "[ ]{1,2}(?:exec|logs|start|stop|restart|rm|kill|inspect|attach)[ ]{1,2}(?:-[a-z]{1,3}[ ]{1,2}){0,3}"),
    "container_option": ("--name[= ]", rf"{_NO_HOLDER}[\w.-]+"),
    "container": _after("container(?:[_ -]?(?:name|id))?", r"(?=[\w.-]*[\d_-])[A-Za-z\d][\w.-]{2,}"),
    "private_domain": r"(?<![\w.-])(?:[A-Za-z\d][A-Za-z\d-]{0,62}\.)+(?i:local|localdomain|internal|intranet|lan|corp|home|private)(?![\w.-])",
    "numbered_host": r"(?<![\w-])(?i:node|host|worker|gpu|server)-\d{1,5}(?![\w-])",
    "machine": _after("remote|machine|box|server|bastion|workstation", r"\d{1,4}(?!\w)", "[ ]"),
    "host": _after("host(?:name)?|server|node|machine", r"(?=[\w.-]*[\d.-])[A-Za-z\d][\w.-]+"),
    "staff_number": r"(?<![\w-])[A-Za-z]{1,2}\d{8}(?![\w-])",
    "ticket": r"(?<![\w-])[A-Z]{2,6}-\d+(?:-\d+)?(?![\w-])",
    "random_token": rf"(?<![\w+/=-])(?=[\w+/=-]{{32}})(?=[\w+/=-]*[A-Z])(?=[\w+/=-]*[a-z])(?=[\w+/=-]*\d)(?!{_HEX}+(?![\w+/=-]))[\w+/=-]{{32,}}",
}
#: A claimed place is held by one character of a private range until all kinds have been looked for.
FIRST_MARK = 0xE000


def marked(rows: DataFrame, text: str, allow: str | None = None) -> DataFrame:
    """The rows with ``redacted`` and ``findings`` (array<struct<kind, value>>, by kind, then place) beside them.

    Kinds are replaced one after another, each by a mark that no later one can match, so that a place
    belongs to the first kind that claims it. ``redacted`` has ``<kind>`` in each place and nothing else
    altered. Values that match ``allow`` as a whole are claimed, but not among the findings. Null texts
    have no findings, and null. A text that holds characters of the marks' range loses these.
    """
    kinds = list(KINDS)
    patterns = [f"({before})({value})" for before, value in (("", f) if isinstance(f, str) else f for f in KINDS.values())]
    marks = [chr(FIRST_MARK + i) for i in range(len(kinds))]
    state = "struct<text: string, findings: array<struct<kind: string, value: string>>>"

    def of(i: Column, choices) -> Column:
        out = F.lit(None)
        for n, choice in enumerate(choices):
            out = F.when(i == n, choice) if n == 0 else out.when(i == n, choice)
        return out

    def claim(s: Column, i: Column) -> Column:
        values = of(i, (F.regexp_extract_all(s["text"], F.lit(p), F.lit(2)) for p in patterns))
        rest = of(i, (F.regexp_replace(s["text"], p, f"$1{m}") for p, m in zip(patterns, marks)))
        kind = of(i, (F.lit(k) for k in kinds))
        taken = lambda v: F.struct(
            rest.alias("text"), F.concat(s["findings"], F.transform(v, lambda x: F.struct(kind.alias("kind"), x.alias("value")))).alias("findings")
        )
        return F.transform(F.array(values), lambda v: F.when(F.size(v) == 0, s).otherwise(taken(v).cast(state)))[0]

    def spelled(s: Column) -> Column:
        done = s["text"]
        for kind, mark in zip(kinds, marks):
            done = F.replace(done, F.lit(mark), F.lit(f"<{kind}>"))
        found = s["findings"] if allow is None else F.filter(s["findings"], lambda f: ~f["value"].rlike(rf"\A(?:{allow})\z"))
        return F.struct(found.alias("findings"), done.alias("redacted"))

    plain = F.regexp_replace(text, f"[{marks[0]}-{marks[-1]}]", "")
    start = F.struct(plain.alias("text"), F.array().cast("array<struct<kind: string, value: string>>").alias("findings")).cast(state)
    folded = F.aggregate(F.sequence(F.lit(0), F.lit(len(kinds) - 1)), start, claim, spelled)
    staged = rows.select("*", F.when(F.col(text).isNotNull(), folded).alias("_done"))
    none = F.array().cast("array<struct<kind: string, value: string>>")
    return staged.select(*rows.columns, F.coalesce("_done.findings", none).alias("findings"), F.col("_done.redacted").alias("redacted"))


def shown(value: Column) -> Column:
    """A value as it may be shown: its first and last character, its length and a digest to tell values apart by."""
    ends = F.concat(F.left(value, F.lit(1)), F.lit("*"), F.right(value, F.lit(1)))
    size = F.length(value).cast("string")
    return F.concat_ws(" ", F.when(F.length(value) > 6, ends).otherwise("*"), size, F.left(F.sha2(value, 256), F.lit(8)))


def scan(rows: DataFrame, key: str, text: str, allow: str | None = None) -> DataFrame:
    """key, kind, place (from 0, within its kind's order), shown of each finding; repeated rows give theirs each."""
    found = marked(rows.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", allow)
    return found.select("key", F.posexplode("findings").alias("place", "f")).select("key", F.col("f.kind").alias("kind"), "place", shown(F.col("f.value")).alias("shown"))


def scan_tree(rows: DataFrame, key: str, document: str, allow: str | None = None) -> DataFrame:
    """key, pointer, part (key or value), kind, shown of JSON objects: names of fields are searched as well as what they hold.

    Nested values are searched as their JSON text, under the pointer of the field. Broken documents have no rows.
    """
    fields = rows.select(F.col(key).alias("key"), F.explode(F.from_json(document, "map<string,string>")).alias("name", "value"))
    both = F.array(F.struct(F.lit("key").alias("part"), F.col("name").alias("text")), F.struct(F.lit("value").alias("part"), F.col("value").alias("text")))
    texts = fields.select("key", F.concat(F.lit("/"), "name").alias("pointer"), F.inline(both)).where("text is not null")
    found = marked(texts, "text", allow).select("key", "pointer", "part", F.explode("findings").alias("f"))
    return found.select("key", "pointer", "part", F.col("f.kind").alias("kind"), shown(F.col("f.value")).alias("shown"))
