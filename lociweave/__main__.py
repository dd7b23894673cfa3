import sys

from lociweave.cli import main

sys.exit(main())
