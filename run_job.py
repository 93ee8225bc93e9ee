"""``spark-submit run_job.py <job> ...``; on a cluster add the zipped package with ``--py-files``."""

from roundhouse.plans.jobs import main

if __name__ == "__main__":
    main()
