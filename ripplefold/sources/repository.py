"""A Git working copy as a source: revisions, the difference of two trees, files at a revision, pull requests.

Runs on the driver, one Git process a call; what it yields (a diff, a file) becomes a DataFrame there and is parsed
in parallel by ``sources.diffs``. Git never waits for a prompt.
"""

from __future__ import annotations

import os
import re
import subprocess
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import DataFrame, SparkSession

from ripplefold.functions.text import REMOTE_STEPS

#: Fixed value: seconds after which a Git process is given up.
PATIENCE = 120


class NotARepository(ValueError):
    """The folder is no Git working copy."""


class UnknownRevision(ValueError):
    """The working copy does not know the revision."""


class CheckoutFailed(RuntimeError):
    """A pull request could not be fetched; the message never holds the token."""


def _git(folder: str, *words: str) -> str:
    made = subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True, timeout=PATIENCE, env={**os.environ, "GIT_TERMINAL_PROMPT": "0"})
    if made.returncode:
        raise RuntimeError(made.stderr.strip() or f"git {words[0]} failed")
    return made.stdout


def plain_remote(url: str) -> str:
    """``functions.text.remote_identity`` of one address."""
    out = url.strip()
    for pattern, into in REMOTE_STEPS:
        out = re.sub(pattern, into.replace("$1", r"\1"), out, count=1)
    return out.lower()


class Repository:
    """One working copy; every method that names a revision checks it first."""

    def __init__(self, folder: str):
        self.folder = folder
        try:
            inside = _git(folder, "rev-parse", "--is-inside-work-tree").strip() == "true"
        except (RuntimeError, OSError):
            inside = False
        if not inside:
            raise NotARepository(folder)

    def resolved(self, revision: str) -> str:
        """The commit that a name stands for."""
        try:
            return _git(self.folder, "rev-parse", "--verify", "--quiet", f"{revision}^{{commit}}").strip()
        except RuntimeError:
            raise UnknownRevision(f"{revision} in {self.folder}") from None

    def is_clean(self) -> bool:
        return not _git(self.folder, "status", "--porcelain").strip()

    def identity(self) -> str | None:
        """Host and path of the origin, the same for all spellings of it; None without one."""
        try:
            return plain_remote(_git(self.folder, "remote", "get-url", "origin")) or None
        except RuntimeError:
            return None

    def difference(self, spark: SparkSession, base: str, head: str) -> DataFrame:
        """(diff_id, raw): the difference of the two trees themselves, with renames; ``diff_id`` is ``base..head``."""
        between = f"{self.resolved(base)}..{self.resolved(head)}"
        raw = _git(self.folder, "diff", "--find-renames", "--no-color", "--no-ext-diff", between)
        return spark.createDataFrame([(f"{base}..{head}", raw)], "diff_id string, raw string")

    def file_at(self, revision: str, path: str) -> str | None:
        """A file's content at a revision; None where it does not exist there."""
        at = self.resolved(revision)
        try:
            return _git(self.folder, "show", f"{at}:{path}")
        except RuntimeError:
            return None


@contextmanager
def pull_request(clone_url: str, head: str, base: str, token: str | None = None) -> Iterator[tuple[Repository, str]]:
    """(working copy at ``head``, commit to compare with), in a folder that is gone afterwards.

    The exact head is fetched, not its branch, which may have moved. It is compared with the merge base of both, or
    with the tip of ``base`` where their histories are unrelated.
    """
    url = clone_url
    if token and clone_url.startswith("http"):
        parts = urlsplit(clone_url)
        url = urlunsplit(parts._replace(netloc=f"x-access-token:{token}@{parts.netloc.rpartition('@')[2]}"))
    with tempfile.TemporaryDirectory(prefix="ripplefold-pr-") as folder:
        try:
            _git(folder, "clone", "--no-tags", "--filter=blob:none", "--no-checkout", url, ".")
            _git(folder, "fetch", "--no-tags", "origin", head)
            _git(folder, "checkout", "--detach", head)
            _git(folder, "fetch", "--no-tags", "origin", base)
            try:
                against = _git(folder, "merge-base", "HEAD", "FETCH_HEAD").strip()
            except RuntimeError:
                against = _git(folder, "rev-parse", "FETCH_HEAD").strip()
            found = Repository(folder)
        except (RuntimeError, subprocess.TimeoutExpired, OSError) as reason:
            said = str(reason)
            raise CheckoutFailed(said.replace(token, "***") if token else said) from None
        yield found, against
