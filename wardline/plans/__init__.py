"""All named queries; importing this package registers them."""

from wardline.plans import (  # noqa: F401
    behavior_plans,
    data_plans,
    intake_plans,
    model_plans,
    scoring_plans,
    stream_plans,
    timeline_plans,
    ueba_plans,
)
from wardline.plans.registry import PLANS, TWINS  # noqa: F401
