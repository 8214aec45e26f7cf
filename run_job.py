"""spark-submit entry point for the command line (``python -m samplesmith`` locally).

    zip -r samplesmith.zip samplesmith
    spark-submit --py-files samplesmith.zip run_job.py merge --all --output <shared>/combined
"""

from samplesmith.__main__ import main

if __name__ == "__main__":
    main()
