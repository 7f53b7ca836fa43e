"""The vault index: tables over a notes table (path, text, mtime), stored or derived where they are asked for."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import duplicates, facts, links, roles, search
from quillgraph.plans.store import VaultStore, file_row


class VaultIndex:
    """Without a store every table is a plan and nothing runs until one is read. With one, notes come parsed from it,
    and the tables below that join or aggregate are written once for a version and then read."""

    def __init__(self, notes: DataFrame, role_key: str = roles.ROLE_KEY, store: VaultStore | None = None):
        self.notes, self.role_key, self.store = notes, role_key, store

    def _kept(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        return self.store.derived(name, df, by) if self.store else df

    @cached_property
    def files(self) -> DataFrame:
        if {"size_bytes", "sha256"} <= set(self.notes.columns):
            return self.notes.select("path", "size_bytes", "mtime", "sha256")
        size, sha = file_row(F.col("text"))
        return self.notes.select("path", size, "mtime", sha)

    @cached_property
    def links(self) -> DataFrame:
        return self._kept("links", links.resolve(facts.wikilinks(self.notes), self.notes.select("path")))

    @cached_property
    def tags(self) -> DataFrame:
        return facts.tags(self.notes)

    @cached_property
    def metadata(self) -> DataFrame:
        return facts.frontmatter(self.notes)

    @cached_property
    def docs(self) -> DataFrame:
        return facts.search_docs(self.notes)

    @cached_property
    def postings(self) -> DataFrame:
        """Dealt by a hash of the term, so that a query reads the folders of its terms."""
        return self._kept("postings", search.postings(self.docs), "part")

    @cached_property
    def doc_lengths(self) -> DataFrame:
        return self._kept("lengths", search.lengths(self.docs))

    @cached_property
    def terms(self) -> DataFrame:
        """path and the words of each note's path, title, headings, tags, tasks and body that near copies and routing compare."""
        words = lambda *c: T.terms(F.concat_ws(" ", *c))
        fields = ("title", "headings", "tags", "tasks", "body")
        return self._kept("terms", self.docs.select("path", "title", words("path_text", *fields).alias("terms"), words(*fields).alias("content_terms")))

    @cached_property
    def degrees(self) -> DataFrame:
        return self._kept("degrees", links.degrees(self.notes, self.links))

    @cached_property
    def members(self) -> DataFrame:
        return self._kept("members", duplicates.assessed(self.files, self.degrees))

    @cached_property
    def note_roles(self) -> DataFrame:
        return roles.note_roles(self.notes, self.metadata, self.role_key)

    @cached_property
    def missing_roles(self) -> DataFrame:
        return self._kept("missing_roles", roles.role_missing(self.docs, self.metadata, self.role_key))
