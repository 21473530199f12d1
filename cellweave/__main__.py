"""python -m cellweave info: what this installation offers, as JSON."""

import json
import sys


def info() -> dict:
    from .plans import catalog, workflows
    from .sources import readers, registry  # noqa: F401

    return {"name": "cellweave", "version": "0.1.0", "kinds": sorted(workflows.BUILDERS), "readers": registry.available_readers(), "queries": sorted(catalog.QUERIES)}


if __name__ == "__main__":
    if sys.argv[1:] != ["info"]:
        sys.exit("usage: python -m cellweave info")
    print(json.dumps(info(), indent=1))
