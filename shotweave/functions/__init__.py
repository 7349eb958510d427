from shotweave.functions.expr import *  # noqa: F401,F403
