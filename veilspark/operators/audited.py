"""Sessions that leave an audit record of every call, refused and failed ones too."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation

from veilspark.errors import AccessDenied
from veilspark.frames import local_frame
from veilspark.operators.audit import audit_event, build_audit, build_denied
from veilspark.operators.catalog import describe_columns
from veilspark.operators.governed import Condition, GovernedSession
from veilspark.operators.masking import observed_fields, project_actions
from veilspark.operators.querylog import GENERIC_TOOL
from veilspark.sources.audit_log import write_audit
from veilspark.sources.tables import param_query

#: A SELECT or one that starts with a common table expression, and a row limit of its own.
_SELECTS = re.compile(r"\s*(?:select|with)\b", re.IGNORECASE)
_LIMITED = re.compile(r"\blimit\s+\S+\s*;?\s*$", re.IGNORECASE)
_PLACE = re.compile(r"\{(\w+)\}")


@dataclass(frozen=True)
class Answer:
    """What a client gets: masked rows, at most its role's cap, and which of their columns were masked."""

    rows: DataFrame
    masked_fields: list[str]


@dataclass(frozen=True)
class AuditedSession:
    """A session whose calls run at once and are written to the audit log at ``path``.

    The record comes from the run itself: rows and masked cells are counted by metrics in
    the running plan, over the rows that are returned. A call that is refused is recorded
    with the tables it asked for and the reason, one that fails with the kind of its error;
    both are raised again. The text is kept without its literals.
    """

    session: GovernedSession
    path: str
    dialect: str = "mysql"
    tz_name: str = "Asia/Shanghai"

    def sql(self, text: str, tables: Sequence[str], args: list | Mapping | None = None, limit: int | None = None) -> Answer:
        """SQL over checked tables, named ``{table}`` in the text."""

        def build(own: GovernedSession) -> DataFrame:
            return param_query(own.spark, text, args, **{t: own.table(t) for t in tables})

        return self.query(build, text, limit)

    def query(self, build: Callable[[GovernedSession], DataFrame], text: str = "", limit: int | None = None) -> Answer:
        """A query built from governed tables; ``text`` is what the record shows of it."""

        def run(own: GovernedSession) -> DataFrame:
            if not own.role.allow_generic_query:
                raise AccessDenied("ROLE_DENIED", "generic queries are not allowed")
            return build(own)

        return self._recorded(run, GENERIC_TOOL, text, limit)

    def plugin_query(
        self,
        sql: str,
        args: list | Mapping | None,
        tables: Sequence[str],
        tool: str = "plugin",
        require_role: str | None = None,
        where: Mapping[str, Sequence[Condition]] | None = None,
    ) -> Answer:
        """See :meth:`GovernedSession.plugin_query`."""

        def run(own: GovernedSession) -> DataFrame:
            return own.plugin_plan(sql, args, tables, tool, require_role, where)

        return self._recorded(run, tool, sql, None)

    def describe(self, table: str) -> DataFrame:
        """Columns of an allowed table with their masking; see :func:`veilspark.operators.catalog.describe_columns`."""
        own = replace(self.session, asked=[table.lower()])
        record = self._recorder(own, "describe_columns", "", None)
        with self._refusals(record):
            columns = describe_columns(own.spark, table, own.role, own.catalog, own.policy)
        self._write(build_audit(record(), self.tz_name))
        return columns

    def _recorded(self, build: Callable[[GovernedSession], DataFrame], tool: str, text: str, limit: int | None) -> Answer:
        own = replace(self.session, handed=[], asked=[])
        record = self._recorder(own, tool, text, limit)
        with self._refusals(record):
            capped, actions = own.prepare(build(own), limit)
            seen = Observation()
            masked = project_actions(capped, actions, own.policy, own.keys, observation=seen)
            rows = local_frame(own.spark, [tuple(r) for r in masked.collect()], masked.schema)
            fields = observed_fields(actions, seen)
        returned = seen.get.get("rows", 0)
        self._write(build_audit(record(masked_columns=fields, rows_returned=returned), self.tz_name))
        return Answer(rows, fields)

    def _recorder(self, own: GovernedSession, tool: str, text: str, limit: int | None) -> Callable[..., DataFrame]:
        """Makes the record of the call that begins now; facts about its end are added."""
        start = time.perf_counter()
        shown = _PLACE.sub(r"\1", text)
        unlimited = limit is None and bool(_SELECTS.match(shown)) and not _LIMITED.search(shown)

        def record(**facts) -> DataFrame:
            spent = int((time.perf_counter() - start) * 1000)
            names = sorted(set(own.asked))
            return audit_event(
                own.spark, own.client, own.role.name, tool, shown, names, self.dialect, duration_ms=spent, unlimited=unlimited, **facts
            )

        return record

    @contextmanager
    def _refusals(self, record: Callable[..., DataFrame]):
        """Writes the record of a call that is refused or fails inside, and lets it go on."""
        try:
            yield
        except AccessDenied as refused:
            self._write(build_denied(record(denied=refused), self.tz_name))
            raise
        except Exception as failed:
            self._write(build_denied(record(error_type=type(failed).__name__), self.tz_name))
            raise

    def _write(self, records: DataFrame) -> None:
        write_audit(records, self.path)
