"""Archive options: defaults, typed setters, coercion, sources and diagnostics."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, fields

ON, OFF = ("ON", "YES", "On", "Yes", "on", "yes", "1", "true"), ("OFF", "NO", "Off", "No", "off", "no", "0", "false")
#: Retired keys.
DEPRECATED = frozenset({"showhr", "usetable", "body"})
OCTAL = ("dirmode", "filemode")
#: Accepted for old files; nothing reads them.
UNUSED = frozenset("""htmlmessage_deleted custom_archives default_top_index mailcommand newmsg_command replymsg_command
inreplyto_command domainaddr icss_url mcss_url link_to_replies quote_link_string ihtmlhelpup ihtmlhelplow ihtmlnavbar2up
attachmentlink unsafe_chars filename_base base_url describe_folder alts_text txtsuffix i18n i18n_body inlinehtml showbr iquotes
usemeta ietf_mbox warn_surpressions files_by_thread report_new_file report_new_folder use_sender_date inline_addlink iso2022jp
delete_incremental external_fonts show_index_links show_msg_links locktime quote_hide_threshold thread_file_depth save_alts
max_messages show_headers avoid_indices avoid_top_indices text_types inline_types prefered_types ignore_types""".split())
RANGES = {"showhtml": (0, 2), "delete_level": (0, 3), "increment": (-1, 1 << 31), "thrdlevels": (0, 1 << 31), "searchbackmsgnum": (0, 1 << 31),
          "startmsgnum": (0, 1 << 31), "msgsperfolder": (0, 1 << 31), "max_message_size": (1, 1 << 62)}
INDEXES = ("date", "subject", "author", "thread", "attachment")


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    # strings
    fragment_prefix: str = "msg"
    antispam_at: str = "_at_"
    antispamdomain: str | None = None
    language: str = "en"
    htmlsuffix: str = "html"
    mbox: str | None = None
    archives: str | None = None
    about: str | None = None
    label: str | None = None
    dir: str | None = None
    defaultindex: str = "thread"
    mailto: str | None = None
    hmail: str | None = None
    css: str | None = None
    dateformat: str | None = None
    indexdateformat: str | None = None
    stripsubject: str | None = None
    ihtmlheader: str | None = None
    ihtmlfooter: str | None = None
    ihtmlhead: str | None = None
    mhtmlheader: str | None = None
    mhtmlfooter: str | None = None
    folder_by_date: str | None = None
    latest_folder: str | None = None
    delete_older: str | None = None
    delete_newer: str | None = None
    append_filename: str | None = None
    description: str | None = None
    theme: str | None = None
    bodyheader: str | None = None
    bodyheaderend: str | None = None
    bodyfooter: str | None = None
    # switches
    email_address_obfuscation: bool = False
    overwrite: bool = False
    readone: bool = False
    reverse: bool = False
    reverse_folders: bool = False
    showheaders: bool = True
    showreplies: bool = True
    indextable: bool = False
    eurodate: bool = True
    gmtime: bool = False
    isodate: bool = False
    require_msgids: bool = True
    discard_dup_msgids: bool = True
    uselock: bool = True
    linkquotes: bool = False
    monthly_index: bool = False
    yearly_index: bool = False
    spamprotect: bool = True
    spamprotect_id: bool = True
    attachmentsindex: bool = True
    usegdbm: bool = False
    writehaof: bool = False
    append: bool = False
    nonsequential: bool = False
    href_detection: bool = True
    mbox_shortened: bool = False
    showgenerator: bool = True
    show_warnings: bool = False
    # integers
    increment: int = 0
    showhtml: int = 1
    thrdlevels: int = 50
    dirmode: int = 0o755
    filemode: int = 0o644
    searchbackmsgnum: int = 500
    startmsgnum: int = 0
    msgsperfolder: int = 0
    delete_level: int = 3
    progress: int = 0
    max_message_size: int = 100 << 20
    # lists
    deleted: tuple[str, ...] = ("x-no-archive",)
    expires: tuple[str, ...] = ("expires",)
    delete_msgnum: tuple[str, ...] = ()
    filter_out: tuple[str, ...] = ()
    filter_require: tuple[str, ...] = ()
    filter_out_full_body: tuple[str, ...] = ()
    filter_require_full_body: tuple[str, ...] = ()
    skip_headers: tuple[str, ...] = ()
    #: accepted options that nothing reads, as given
    unused: dict[str, str] = field(default_factory=dict)

    def kind(self, key: str) -> str:
        for f in fields(self):
            if f.name == key and key != "unused":
                return f.type if f.type in ("bool", "int") else "list" if f.type.startswith("tuple") else "str"
        return "unused" if key in UNUSED else "unknown"

    def set(self, key: str, value: str) -> None:
        """Sets an option from text; `key=value` in key, and the prefixes hm_ and set_, are taken."""
        if "=" in key:
            key, _, value = key.partition("=")
        key, value = key.strip().removeprefix("hm_").removeprefix("set_"), value.strip()
        if key in DEPRECATED:
            raise ConfigError(f"deprecated config key {key}: has no effect; remove it")
        kind = self.kind(key)
        if kind == "unknown":
            raise ConfigError(f"unrecognized config key: {key}")
        if kind == "unused":
            self.unused[key] = value
        elif kind == "bool":
            if value not in ON + OFF:
                raise ConfigError(f"{key} is on or off, not {value!r}")
            setattr(self, key, value in ON)
        elif kind == "int":
            setattr(self, key, self._integer(key, value))
        elif kind == "list":
            words = () if value.upper() == "NONE" else tuple(value.split())
            setattr(self, key, tuple(dict.fromkeys((*getattr(self, key), *words))) if words else ())
        else:
            setattr(self, key, None if value.upper() == "NONE" else value)

    @staticmethod
    def _integer(key: str, value: str) -> int:
        try:
            n = 1 if value in ON[:6] else 0 if value in OFF[:6] else int(value, 8 if key in OCTAL else 10)
        except ValueError:
            raise ConfigError(f"{key} is a number, not {value!r}") from None
        low, high = RANGES.get(key, (-(1 << 62), 1 << 62))
        if not low <= n <= high:
            raise ConfigError(f"{key} is from {low} to {high}, not {n}")
        return n

    def finish(self) -> Config:
        """Headers that are shown elsewhere are always skipped."""
        self.skip_headers = tuple(dict.fromkeys((*self.skip_headers, "from", "date", "subject")))
        return self

    def css_path(self) -> str:
        if not self.css:
            return ""
        if self.css.startswith(("http", "/")) or not self.dir:
            return self.css
        return f"{self.dir.rstrip('/')}/{self.css}"


def entries(text: str) -> Iterable[tuple[int, str, str | None, str]]:
    """(line number, source, key or None if malformed, value)."""
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        m = re.match(r"(?:set )?([^=]*?)\s*=\s*(.*)$", line) or re.match(r"(?:set )?([^:]*?)\s*:\s*(.*)$", line)
        yield (n, line, m[1].strip(), m[2].strip().strip('"')) if m else (n, line, None, "")


def load(text: str = "", environ: Mapping[str, str] | None = None, options: Iterable[str] = (), flags: Mapping[str, object] | None = None) -> Config:
    """Environment (HM_*) below the file below -o options below flags. What can't be set is left."""
    config = Config()
    given = [(k[3:].lower(), v) for k, v in (environ or {}).items() if k.startswith("HM_")]
    given += [(k, v) for _, _, k, v in entries(text) if k]
    given += [tuple(o.split("=", 1)) if "=" in o else (o, "on") for o in options]
    for key, value in given:
        try:
            config.set(key, value)
        except ConfigError:
            continue
    for key, value in (flags or {}).items():
        if config.kind(key) in ("unknown", "unused"):
            raise ConfigError(f"unrecognized option: {key}")
        setattr(config, key, tuple(value) if config.kind(key) == "list" else value)
    return config.finish()


@dataclass(frozen=True)
class Diagnostic:
    line: int
    severity: str
    source: str
    message: str


@dataclass(frozen=True)
class Rule:
    """What the options together must not be: broken by values as text, told at the key's line."""

    key: str
    broken: Callable[[Mapping[str, str]], bool]
    says: str


def _on(values: Mapping[str, str], key: str) -> bool:
    return values.get(key, "").lower() in ("on", "yes", "1", "true")


RULES = (
    Rule("mbox_shortened", lambda v: _on(v, "mbox_shortened") and not _on(v, "usegdbm"), "needs usegdbm"),
    Rule("mbox_shortened", lambda v: _on(v, "mbox_shortened") and v.get("increment", "0").lower() not in ("0", "off", "no", "false"), "needs an increment of 0"),
    Rule("msgsperfolder", lambda v: v.get("folder_by_date", "") != "" and v.get("msgsperfolder", "0") != "0", "and folder_by_date exclude each other"),
    Rule("dir", lambda v: ".." in v.get("dir", ""), "must not lead upwards"),
    Rule("defaultindex", lambda v: v.get("defaultindex", INDEXES[0]) not in INDEXES, f"is one of {', '.join(INDEXES)}"),
)


def validate(text: str) -> list[Diagnostic]:
    """What is wrong with a config file: lines that can't be set, then rules that the set ones break."""
    found, given, at = [], {}, {}
    for n, source, key, value in entries(text):
        name = (key or "").removeprefix("hm_").removeprefix("set_")
        try:
            if key is None:
                raise ConfigError("is neither an assignment nor a comment")
            Config().set(name, value)
            given[name], at[name] = value, n
        except ConfigError as e:
            ignored = name in DEPRECATED or key is not None and Config().kind(name) == "unknown"
            found.append(Diagnostic(n, "warning" if ignored else "error", source, str(e)))
    return found + [Diagnostic(at[r.key], "error", f"{r.key} = {given[r.key]}", f"{r.key} {r.says}") for r in RULES if r.key in given and r.broken(given)]


def check(config: Config) -> list[str]:
    """Combinations that can't run."""
    values = {f.name: "" if (v := getattr(config, f.name)) is None else "on" if v is True else "off" if v is False else str(v) for f in fields(config)}
    return [f"{r.key} {r.says}" for r in RULES if r.key != "dir" and r.broken(values)]
