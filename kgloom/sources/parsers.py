"""Parsers: change events of a source into documents and graph hints, one DataFrame transform for each source type."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {}
MOST_RECIPIENTS, MOST_ATTENDEES, MOST_EMBEDS, MOST_DEPENDENCIES, MOST_MANIFEST = 100, 200, 50, 500, 1 << 20


def parser(source_type: str):
    """Registers a parser for a source type."""

    def keep(f):
        REGISTRY[source_type] = f
        return f

    return keep


def parse(source_type: str, events: DataFrame) -> DataFrame:
    return REGISTRY[source_type](events)


def hints(rows: DataFrame, label: str, rel: str | Column, to_label: str | Column, to_id: Column, confidence: float = 1.0, subject: Column | None = None) -> DataFrame:
    """Edges from each row's document to ``to_id``; rows without one give none."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = rows.select(
        F.lit(label).alias("src_label"), (F.col("source_id") if subject is None else subject).alias("src_id"), as_col(rel).alias("rel"),
        as_col(to_label).alias("dst_label"), to_id.alias("dst_id"), F.lit(confidence).alias("confidence"), F.lit(True).alias("hint"),
    )
    return out.where("dst_id IS NOT NULL AND dst_id <> ''").distinct()


def address(raw: Column) -> Column:
    """The bare address of ``Name <address>``, canonical."""
    return T.canonical_email(F.regexp_extract(raw, T.EMAIL, 0))


def person(mail: Column) -> Column:
    return F.when(mail != "", F.concat(F.lit("person:"), mail))


def mentions(rows: DataFrame, label: str, text_col: str = "text") -> DataFrame:
    """MENTIONS of each address, and REFERENCES for each source link, in a text."""
    people = rows.withColumn("_m", F.explode(T.emails(F.col(text_col))))
    links = rows.withColumn("_l", F.explode(T.source_links(F.col(text_col))))
    return hints(people, label, "MENTIONS", "Person", person(F.col("_m"))).unionByName(hints(links, label, "REFERENCES", F.col("_l.object_label"), F.col("_l.object_id")))


@parser("gmail")
def mail(messages: DataFrame) -> DataFrame:
    """SENT from the sender, TO up to 100 recipients, PART_OF the thread; attachments ATTACHED_TO the mail."""
    sender = messages.withColumn("_p", person(address(F.col("sender"))))
    sent = hints(sender, "Person", "SENT", "Email", F.col("source_id"), subject=F.col("_p")).where("src_id IS NOT NULL")
    to = messages.withColumn("_p", F.explode(F.slice(F.split("recipients", r",\s*"), 1, MOST_RECIPIENTS)))
    thread = messages.withColumn("_t", F.concat(F.regexp_extract("source_id", "^(gmail://[^/]*)/", 1), F.lit("/thread/"), "thread_id"))
    attached = messages.withColumn("_a", F.explode("attachments")).withColumn("_i", F.concat_ws("/attachment/", "source_id", "_a.name"))
    return (
        sent.unionByName(hints(to, "Email", "TO", "Person", person(address(F.col("_p")))))
        .unionByName(hints(thread, "Email", "PART_OF", "Thread", F.col("_t")))
        .unionByName(hints(attached, "Attachment", "ATTACHED_TO", "Email", F.col("source_id"), subject=F.col("_i")))
        .unionByName(mentions(messages.withColumn("text", F.coalesce("plain", T.html_text(F.col("html")))), "Email"))
    )


@parser("google_calendar")
def calendar(events: DataFrame) -> DataFrame:
    """People hang on the series where an event recurs; oneself is left out; the creator counts where another one organises."""
    owner = F.coalesce(F.concat(F.regexp_extract("source_id", "^(google-calendar://[^/]*)/", 1), F.lit("/series/"), "series_id"), F.col("source_id"))
    anchored = events.withColumn("_owner", owner)
    label = "CalendarEvent"
    organiser, creator = address(F.col("organizer.email")), address(F.col("creator.email"))
    going = anchored.withColumn("_a", F.explode(F.slice(F.filter("attendees", lambda a: ~F.coalesce(a["self"], F.lit(False))), 1, MOST_ATTENDEES)))
    instance = hints(events.where("series_id IS NOT NULL").withColumn("_s", owner), label, "INSTANCE_OF", "CalendarSeries", F.col("_s"))
    return (
        instance.unionByName(hints(anchored, label, "ORGANIZED_BY", "Person", person(organiser), subject=F.col("_owner")))
        .unionByName(hints(going, label, "ATTENDED_BY", "Person", person(address(F.col("_a.email"))), subject=F.col("_owner")))
        .unionByName(hints(anchored.where(~creator.eqNullSafe(organiser)), label, "CREATED_BY", "Person", person(creator), subject=F.col("_owner")))
    )


@parser("slack")
def chat(windows: DataFrame) -> DataFrame:
    """Windows of messages (source_id, team_id, channel_id, messages array<struct<ts,user,subtype,bot_id,text>>): authors, mentions, channel, addresses."""
    user = lambda u: F.concat(F.lit("slack-user:"), F.col("team_id"), F.lit("/"), u)
    shown = windows.withColumn("messages", F.filter("messages", lambda m: ~filtered_subtype(m)))
    authors = shown.withColumn("_u", F.explode(F.array_distinct(F.transform("messages", lambda m: m["user"]))))
    said = shown.withColumn("text", F.array_join(F.transform("messages", lambda m: F.coalesce(m["text"], F.lit(""))), "\n"))
    named = said.withColumn("_u", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"<@([A-Z0-9-]+)(?:\|[^>]*)?>"), F.lit(1)))))
    channel = F.concat(F.lit("slack://"), "team_id", F.lit("/"), "channel_id")
    return (
        hints(authors, "SlackMessage", "SENT_BY", "Person", user(F.col("_u")))
        .unionByName(hints(named, "SlackMessage", "MENTIONS", "Person", user(F.col("_u"))))
        .unionByName(hints(shown, "SlackMessage", "IN_CHANNEL", "Channel", channel))
        .unionByName(mentions(said, "SlackMessage"))
    )


def filtered_subtype(m: Column) -> Column:
    """Joins, leaves, and bot messages without text."""
    kind = F.coalesce(m["subtype"], F.lit(""))
    return kind.isin("channel_join", "channel_leave") | ((kind == "bot_message") & (F.trim(F.coalesce(m["text"], F.lit(""))) == ""))


def render_chat(messages: Column) -> Column:
    """``[HH:MM UTC] user: text`` lines."""
    from ..functions.times import chat_clock

    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), chat_clock(m["ts"]), F.lit("] "), F.coalesce(m["user"], F.lit("")), F.lit(": "), F.coalesce(m["text"], F.lit("")))), "\n")


FRONT = r"\A---[ \t]*\r?\n(?s:(.*?))\r?\n---[ \t]*(?:\r?\n|\z)"


def front_matter(text: Column) -> Column:
    """The lines between the two rules that a note may begin with, else ''."""
    return F.regexp_extract(text, FRONT, 1)


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), r"""^(["'])(.*)\1$""", "$2")


def front_values(front: Column, key: str) -> Column:
    """Values of a key: one after the colon, a list in brackets, or a line with a dash for each; none if the key is not there. Nested keys are not read."""
    line = F.trim(F.regexp_extract(front, rf"(?m)^{key}:[ \t]*(.*?)[ \t]*$", 1))
    block = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t]*-[ \t]+.*(?:\r?\n|\z))+)", 1)
    dashes = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]+(.*?)[ \t]*$"), F.lit(1)), _unquoted)
    inside = F.transform(F.split(F.regexp_extract(line, r"^\[(.*)\]$", 1), ","), _unquoted)
    one = F.when(line.rlike(r"^\[.*\]$"), inside).when(line != "", F.array(_unquoted(line))).otherwise(dashes)
    return F.filter(one, lambda x: x != "")


def note_properties(files: DataFrame, categories_key: str = "categories") -> DataFrame:
    """(source_id, title, aliases, created, updated, categories, tags, emails, web_clip, source_url) that notes say of themselves; null or empty where they don't."""
    front = front_matter(F.col("text"))
    first = lambda key: F.get(front_values(front, key), F.lit(0))
    url = F.coalesce(first("url"), first("source_url"))
    mails = F.flatten(F.transform(front_values(front, "emails"), lambda x: F.split(x, ",")))
    return files.select(
        "source_id", first("title").alias("title"), front_values(front, "aliases").alias("aliases"), first("created").alias("created"), first("updated").alias("updated"),
        front_values(front, categories_key).alias("categories"), F.filter(F.transform(front_values(front, "tags"), lambda t: F.ltrim(t, F.lit("#"))), lambda t: t != "").alias("tags"),
        F.array_distinct(F.filter(F.transform(mails, T.canonical_email), lambda m: m.contains("@"))).alias("emails"), url.isNotNull().alias("web_clip"), url.alias("source_url"),
    )


@parser("obsidian")
def notes(files: DataFrame) -> DataFrame:
    """Wiki links, tags outside of code, addresses and source links of notes (source_id, vault, text), and what their front matter says: tags, addresses, and a tag ``category/name`` for each category."""
    bare = files.withColumn("text", F.regexp_replace("text", FRONT, ""))
    prose = F.regexp_replace("text", r"(?s)```.*?```|`[^`\n]*`", " ")
    linked = bare.withColumn("_l", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<!!)\[\[([^\]|#]+)"), F.lit(1)))))
    tagged = bare.withColumn("_t", F.explode(F.array_distinct(F.regexp_extract_all(prose, F.lit(r"(?:^|\s)#([A-Za-z][\w/-]*)"), F.lit(1)))))
    target = F.concat_ws("/", "vault", F.concat(F.trim("_l"), F.lit(".md")))
    said = note_properties(files)
    name = F.regexp_replace(F.regexp_extract("source_id", r"([^/]*)$", 1), r"\.[^.]*$", "")
    told = said.withColumn("_t", F.explode("tags"))
    filed = said.withColumn("_c", F.explode("categories")).withColumn("_t", F.concat(F.lit("omnifocus-tag:"), F.col("_c"), F.lit("/"), name))
    people = said.withColumn("_m", F.explode("emails"))
    return (
        hints(linked, "File", "LINKS_TO", "File", target)
        .unionByName(hints(tagged, "File", "TAGGED_BY_USER", "Tag", F.col("_t")))
        .unionByName(hints(told, "File", "TAGGED_BY_USER", "Tag", F.col("_t")))
        .unionByName(hints(filed, "File", "TAGGED_BY_USER", "Tag", F.col("_t")))
        .unionByName(hints(people, "File", "MENTIONS", "Person", person(F.col("_m"))))
        .unionByName(mentions(bare, "File"))
        .distinct()
    )


def attachment_counters(attachments: DataFrame, *by: str) -> DataFrame:
    """Attachments (``indexed`` boolean) that were meant to be read, were read, and are known by name alone."""
    read = F.coalesce(F.col("indexed"), F.lit(False))
    return attachments.groupBy(*by).agg(F.count("*").alias("intended"), F.count_if(read).alias("indexed"), F.count_if(~read).alias("metadata_only"))


def embeds(text: Column) -> Column:
    """Embedded files of a note, at most 50."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"!\[\[([^\]|#]+)"), F.lit(1))), 1, MOST_EMBEDS)


@parser("omnifocus")
def tasks(rows: DataFrame) -> DataFrame:
    """Tasks (source_id, name, note, tags, project, parent): tags, project, parent, people by address, @Name and People/ tags."""
    said = rows.withColumn("text", F.concat_ws("\n", "name", "note"))
    tagged = rows.withColumn("_t", F.explode("tags"))
    at = said.withColumn("_n", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\w@.])@([A-Z][\w-]*(?: [A-Z][\w-]*)?)"), F.lit(1)))))
    by_tag = tagged.where(F.col("_t").rlike("^People/"))
    named = lambda c: F.concat(F.lit("name:"), c)
    return (
        hints(tagged, "Task", "TAGGED", "Tag", F.col("_t"))
        .unionByName(hints(rows, "Task", "IN_PROJECT", "Project", F.col("project")))
        .unionByName(hints(rows, "Task", "SUBTASK_OF", "Task", F.col("parent")))
        .unionByName(hints(at, "Task", "MENTIONS", "Person", named(F.col("_n")), 0.9))
        .unionByName(hints(by_tag, "Task", "MENTIONS", "Person", named(F.regexp_replace("_t", "^People/", "")), 0.95))
        .unionByName(mentions(said, "Task"))
    )


@parser("repositories")
def commits(rows: DataFrame) -> DataFrame:
    """Commits (source_id, author_email, repository, changed_files): author, repository, files."""
    changed = rows.withColumn("_f", F.explode("changed_files"))
    author = person(T.canonical_email(F.col("author_email")))
    return (
        hints(rows, "Person", "AUTHORED", "Commit", F.col("source_id"), subject=author).where("src_id IS NOT NULL")
        .unionByName(hints(rows, "Commit", "PART_OF", "Repository", F.col("repository")))
        .unionByName(hints(changed, "Commit", "MODIFIED", "File", F.concat_ws("/", "repository", "_f")))
    )


@parser("apps")
def applications(rows: DataFrame) -> DataFrame:
    """Applications (source_id, category, binaries, installed_via)."""
    tools = rows.withColumn("_b", F.explode("binaries"))
    return (
        hints(rows, "Application", "CATEGORIZED_AS", "Category", F.col("category"))
        .unionByName(hints(tools, "Application", "PROVIDES", "Command", F.col("_b")))
        .unionByName(hints(rows, "Application", "INSTALLED_VIA", "Source", F.col("installed_via")))
    )


@parser("homebrew")
def packages(rows: DataFrame) -> DataFrame:
    """Packages (source_id, kind, binaries, bundle_id): commands and way of installing; a cask is an application, and the same as the bundle that it brought."""
    formulae, casks = rows.where("kind = 'formula'"), rows.where("kind = 'cask'")
    tools = formulae.withColumn("_b", F.explode("binaries"))
    return (
        hints(tools, "Tool", "PROVIDES", "Command", F.concat(F.lit("command:"), F.col("_b")))
        .unionByName(hints(formulae, "Tool", "INSTALLED_VIA", "Source", F.lit("source:brew_formula")))
        .unionByName(hints(casks, "Application", "INSTALLED_VIA", "Source", F.lit("source:brew_cask")))
        .unionByName(hints(casks.where("bundle_id <> ''"), "Application", "SAME_AS", "Application", F.concat(F.lit("app://"), F.col("bundle_id"))))
    )


def package_text(name: Column, version: Column, description: Column) -> Column:
    """``name (v1.2) — description``, without what is missing."""
    shown = F.when(F.coalesce(version, F.lit("")) != "", F.concat(name, F.lit(" (v"), version, F.lit(")"))).otherwise(name)
    return F.array_join(F.filter(F.array(shown, description), lambda x: x != ""), " — ")


_REQUIREMENT = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(.*?)\s*(?:;.*)?$")


def manifest_dependencies(name: str, text: str | None) -> list[tuple[str, str, str, str]]:
    """(package, version constraint, kind of dependency, ecosystem) of a manifest; none for what cannot be read."""
    if not text or len(text) > MOST_MANIFEST:
        return []
    base, out = name.rsplit("/", 1)[-1], []
    version = lambda v: v if isinstance(v, str) else str(v.get("version", "")) if isinstance(v, dict) else ""
    try:
        if base == "Cargo.toml":
            content = tomllib.loads(text)
            for key, kind in (("dependencies", "runtime"), ("dev-dependencies", "dev"), ("build-dependencies", "build")):
                out += [(n, version(v), kind, "cargo") for n, v in content.get(key, {}).items()]
        elif base == "pyproject.toml":
            content = tomllib.loads(text)
            project, poetry = content.get("project", {}), content.get("tool", {}).get("poetry", {})
            listed = [("runtime", r) for r in project.get("dependencies", [])] + [(group, r) for group, rs in project.get("optional-dependencies", {}).items() for r in rs]
            out += [(m[1], m[2], kind, "pypi") for kind, r in listed if (m := _REQUIREMENT.match(r))]
            out += [(n, version(v), "runtime", "pypi") for n, v in poetry.get("dependencies", {}).items() if n != "python"]
            out += [(n, version(v), "dev", "pypi") for g in poetry.get("group", {}).values() for n, v in g.get("dependencies", {}).items()]
        elif base == "package.json":
            content = json.loads(text)
            for key, kind in (("dependencies", "runtime"), ("devDependencies", "dev"), ("peerDependencies", "peer")):
                out += [(n, str(v), kind, "npm") for n, v in content.get(key, {}).items()]
        elif base == "go.mod":
            blocks = re.sub(r"(?s)require\s*\((.*?)\)", lambda m: "\n".join("require " + x.strip() for x in m[1].splitlines() if x.strip()), text)
            out += [(m[1], m[2], "indirect" if "// indirect" in m[0] else "runtime", "go") for m in re.finditer(r"^require\s+(\S+)\s+(v\S+).*$", blocks, re.MULTILINE)]
        elif base.endswith((".csproj", ".fsproj", ".vbproj", ".props")) or base == "packages.config":
            out += [(m[1], m[2] or "", "runtime", "nuget") for m in re.finditer(r'<(?:PackageReference|PackageVersion)\s+[^>]*?Include="([^"]+)"(?:[^>]*?\sVersion="([^"]*)")?', text)]
            out += [(m[1], m[2], "runtime", "nuget") for m in re.finditer(r'<package\s+id="([^"]+)"\s+version="([^"]*)"', text)]
    except (tomllib.TOMLDecodeError, json.JSONDecodeError, AttributeError):
        return []
    return out[:MOST_DEPENDENCIES]


def dependencies(manifests: DataFrame) -> DataFrame:
    """source_id, package, version_constraint, dependency_type, ecosystem for manifests (source_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *d) for i, t in zip(batch["source_id"], batch["text"]) for d in manifest_dependencies(i, t)]
            yield pd.DataFrame(rows, columns=["source_id", "package", "version_constraint", "dependency_type", "ecosystem"])

    return manifests.select("source_id", "text").mapInPandas(run, "source_id string, package string, version_constraint string, dependency_type string, ecosystem string")


def route(files: DataFrame) -> DataFrame:
    """How a file is read, by type and size: text, pdf, image, or metadata alone."""
    mime, mb = T.plain_mime(F.col("mime_type")), 1 << 20
    return files.withColumn("route", F.when((mime.startswith("text/") | mime.isin("application/json", "application/yaml", "application/x-yaml")) & (F.col("size") <= 10 * mb), "text").when((mime == "application/pdf") & (F.col("size") <= 100 * mb), "pdf").when(mime.startswith("image/") & (F.col("size") <= 50 * mb), "image").otherwise("metadata_only"))


def references(chunks: DataFrame, vaults: dict[str, str] | None = None, teams: dict[str, str] | None = None) -> DataFrame:
    """(src_id, rel, dst_label, dst_id) of the source links in stored chunks (source_id, chunk_index, text), for documents indexed before links were kept. A document's chunks are joined in order; links to itself go."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"])
    whole = chunks.where("text IS NOT NULL").groupBy("source_id").agg(F.array_join(ordered, "\n").alias("text"))
    found = whole.select(F.col("source_id").alias("src_id"), F.explode(T.source_links(F.col("text"), vaults, teams)).alias("l"))
    return found.where(F.col("src_id") != F.col("l.object_id")).select("src_id", F.lit("REFERENCES").alias("rel"), F.col("l.object_label").alias("dst_label"), F.col("l.object_id").alias("dst_id")).distinct()
