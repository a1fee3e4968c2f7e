"""Role grants, role contexts, path confinement and a gate for user code."""

from __future__ import annotations

import ast
import functools
import os
from dataclasses import dataclass, field

ALL = "ALL"
LEVELS = {"guest": 0, "analyst": 1, "admin": 2}


class AccessController:
    """Grants by role and table; * stands for every table. Revoking any permission from a holder of ALL takes ALL too."""

    def __init__(self) -> None:
        self._grants: dict[str, dict[str, set[str]]] = {"admin": {"*": {ALL}}, "analyst": {"*": {"SELECT", "INSERT"}}, "guest": {"*": {"SELECT"}}}

    def grant(self, role: str, table: str, permission: str) -> None:
        self._grants.setdefault(role, {}).setdefault(table, set()).add(permission.upper())

    def revoke(self, role: str, table: str, permission: str) -> None:
        held = self._grants.get(role, {}).get(table, set())
        held.discard(permission.upper())
        held.discard(ALL)

    def check_permission(self, who: str | RoleContext, table: str, permission: str) -> bool:
        context = who if isinstance(who, RoleContext) else RoleContext(who)
        permission = permission.upper()
        held = set(context.extra.get(table, set())) | set(context.extra.get("*", set()))
        for name in (table, "*"):
            held |= self._grants.get(context.role, {}).get(name, set())
        return ALL in held or permission in held

    def require(self, who: str | RoleContext, table: str, permission: str) -> None:
        if not self.check_permission(who, table, permission):
            role = who.role if isinstance(who, RoleContext) else who
            raise PermissionError(f"{role} may not {permission.upper()} on {table}")


@dataclass(frozen=True)
class RoleContext:
    """A role with permissions of its own, by table."""

    role: str
    extra: dict[str, frozenset[str]] = field(default_factory=dict)

    def is_admin(self) -> bool:
        return self.role == "admin"

    def at_least(self, role: str) -> bool:
        return LEVELS.get(self.role, -1) >= LEVELS[role]


def require_role(role: str):
    """Decorator: the call's ``context`` must hold the role or a higher one."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, context: RoleContext, **kwargs):
            if not context.at_least(role):
                raise PermissionError(f"{context.role} is below {role}")
            return f(*args, context=context, **kwargs)

        return run

    return wrap


def is_safe_path(path: str, root: str) -> bool:
    """Whether a path stays inside root once links and dots are resolved; null bytes never do."""
    if "\0" in path or "\0" in root:
        return False
    root = os.path.realpath(root)
    return os.path.commonpath([root, os.path.realpath(os.path.join(root, path))]) == root


#: Modules and names that user code may not reach.
BANNED_MODULES = frozenset("subprocess socket ctypes pickle shelve marshal pty shutil posix resource signal importlib _thread os sys multiprocessing threading builtins".split())
BANNED_NAMES = frozenset("eval exec compile __import__ getattr setattr delattr globals locals vars breakpoint input".split())


def validate_safe_code(code: str, banned: frozenset[str] = BANNED_MODULES) -> str | None:
    """None for code that may be registered as a function, else why not: banned imports, reflection, writing to files."""
    try:
        tree = ast.parse(code)
    except SyntaxError as e:
        return f"Security Exception: code does not parse: {e.msg}"
    for node in ast.walk(tree):
        modules = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
        for name in modules:
            if name.partition(".")[0] in banned:
                return f"Security Exception: import of {name}"
        if isinstance(node, ast.Name) and node.id in BANNED_NAMES:
            return f"Security Exception: use of {node.id}"
        if isinstance(node, ast.Attribute) and node.attr.startswith("__") and node.attr.endswith("__"):
            return f"Security Exception: use of {node.attr}"
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "open":
            mode = next((k.value for k in node.keywords if k.arg == "mode"), node.args[1] if len(node.args) > 1 else ast.Constant("r"))
            if not isinstance(mode, ast.Constant) or set(str(mode.value)) & set("wax+"):
                return "Security Exception: open for writing"
    return None
