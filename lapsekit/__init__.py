"""lapsekit: customer-retention and basket analytics as Spark DataFrame jobs.

Sub-packages:

* ``sources``   -- schemas, readers/writers, the test-table adapter
* ``functions`` -- column expressions (scalar steps)
* ``operators`` -- table-in / table-out analysis steps
* ``plans``     -- the registered queries built from the operators
* ``streaming`` -- streaming forms of the click-stream counts and sessions
"""

from lapsekit.session import ensure_checkpoint_dir, get_session

__all__ = ["ensure_checkpoint_dir", "get_session"]
