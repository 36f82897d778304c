from . import api, data, evaluate, explore, models, monitor, ranking, shape  # noqa: F401
