"""Entry point for spark-submit; see tabscope/plans/job.py."""

import sys

from tabscope.plans.job import main

sys.exit(main())
