import sys

from hashloom.cli import main

sys.exit(main())
