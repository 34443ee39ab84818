"""Names of conftest that tests import."""

from importlib import util
from pathlib import Path

_spec = util.spec_from_file_location("llm_conftest", Path(__file__).with_name("conftest.py"))
_module = util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
EXTRA, SCHEMA, WORDS, prose, edge_rows = _module.EXTRA, _module.SCHEMA, _module.WORDS, _module.prose, _module.edge_rows
