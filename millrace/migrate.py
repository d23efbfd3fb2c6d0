"""Migrations: numbered scripts that a database has run or not."""

from __future__ import annotations

from dataclasses import dataclass, field

from .database import Database

LOG = "_migrations"


@dataclass(frozen=True)
class Migration:
    version: int
    up: str
    down: str | None = None


@dataclass
class Migrator:
    """Runs what a database hasn't run yet, in the order of the versions, each in a transaction of its own."""

    migrations: list[Migration] = field(default_factory=list)

    def add(self, migration: Migration) -> None:
        self.migrations.append(migration)

    def applied(self, db: Database) -> list[int]:
        if not db.table_exists(LOG):
            db.exec(f"CREATE TABLE {LOG} (version INTEGER PRIMARY KEY)")
        return sorted(r[0] for r in db.exec(f"SELECT version FROM {LOG}").rows())

    def apply(self, db: Database) -> int:
        """The highest version that the database has run by now; 0 if none."""
        done = set(self.applied(db))
        for m in sorted(self.migrations, key=lambda m: m.version):
            if m.version not in done:
                with db.transaction():
                    db.exec(m.up)
                    db.exec(f"INSERT INTO {LOG} VALUES (?)", [m.version])
                done.add(m.version)
        return max(done, default=0)

    def rollback(self, db: Database) -> int:
        """Undo the last version that has a down script; that version, or 0."""
        done = set(self.applied(db))
        for m in sorted(self.migrations, key=lambda m: -m.version):
            if m.version in done and m.down:
                with db.transaction():
                    db.exec(m.down)
                    db.exec(f"DELETE FROM {LOG} WHERE version = ?", [m.version])
                return m.version
        return 0
