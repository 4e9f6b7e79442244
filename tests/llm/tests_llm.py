"""Names shared by the tests of this folder."""

from importlib.util import module_from_spec, spec_from_file_location
from pathlib import Path

_spec = spec_from_file_location("llm_conftest", Path(__file__).with_name("conftest.py"))
_module = module_from_spec(_spec)
_spec.loader.exec_module(_module)
make, prose, words = _module.make, _module.prose, _module.words
