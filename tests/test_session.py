"""The archive that executors import the package from."""

import importlib.util
import subprocess
import sys

from flowlens import session
from flowlens.session import package_archive


def test_every_subpackage_imports_from_the_archive(tmp_path):
    archive = tmp_path / "flowlens.zip"
    archive.write_bytes(package_archive())
    code = f"import sys; sys.path.insert(0, {str(archive)!r}); import flowlens.operators.explain as m, flowlens.plans.registry; print(m.__file__)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip().startswith(str(archive))


def imported_anew(spec_name, path):
    spec = importlib.util.spec_from_file_location(spec_name, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_a_second_import_in_one_application_ships_nothing_twice(spark):
    session.ship_package(spark)
    files = sorted(spark.sparkContext.listFiles)
    again = imported_anew("flowlens.session", session.__file__)
    again.ship_package(spark)
    assert sorted(spark.sparkContext.listFiles) == files
    assert again.package_archive() == package_archive()


def test_changed_code_runs_in_workers_that_have_not_imported_the_old(spark, monkeypatch):
    def worker_package(_):
        import os

        yield os.environ.get("FLOWLENS_PACKAGE")

    def seen():
        return set(spark.sparkContext.parallelize(range(4), 4).mapPartitions(worker_package).collect())

    session.ship_package(spark)
    before, shipped = seen(), dict(spark.sparkContext.environment)
    assert len(before) == 1 and None not in before
    changed = imported_anew("flowlens.session", session.__file__)
    other = package_archive() + b"\0"
    monkeypatch.setattr(changed, "package_archive", lambda: other)
    try:
        changed.ship_package(spark)
        assert len(seen() | before) == 2
    finally:
        spark.sparkContext.environment.update(shipped)
    assert seen() == before
